"""Token ids of a corpus as files of rANS blocks in ascending document order."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import END_ID, encoder, vocabulary_path
from .rans import Coder, Corrupt, shared_table
from .work import mapped, scratch, width, written

BLOCK_IDS = 1 << 20
FILE_SCHEMA = "part int, block int, start_in_part long, doc_ids array<long>, doc_sizes array<long>, n_ids long, table_crc long, data binary"
_FILE_NAMES = [c.split()[0] for c in FILE_SCHEMA.split(", ")]
_FILE_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
TABLE_SCHEMA = "freqs binary, crc32 long"


def tokenized(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """Rows (key, ids): each whole text's ids, and the end id, as little-endian unsigned 16-bit integers. A null text is empty."""
    path = path or vocabulary_path()
    end = b"" if end_id is None else int(end_id).to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("k"), encode.encode(b.column("t"), end)], names=[key, "ids"])

    return mapped(df.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")), run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids binary")


def counted(df: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """Rows (doc_id, ids, counts) as ``tokenized``, and one row more for each task, with how often it saw each id, as 64-bit integers."""
    size = encoder(path).size
    end = b"" if end_id is None else int(end_id).to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, n = encoder(path), np.zeros(size, np.int64)
        names = ["doc_id", "ids", "counts"]
        for b in batches:
            ids = encode.encode(b.column("t"), end)
            first, last = (ids.buffers()[1][4 * (ids.offset + i) : 4 * (ids.offset + i) + 4].to_pybytes() for i in (0, len(ids)))
            first, last = int.from_bytes(first, "little"), int.from_bytes(last, "little")
            if last > first:
                n += np.bincount(np.frombuffer(ids.buffers()[2], np.uint16, (last - first) // 2, first), minlength=size)
            yield pa.RecordBatch.from_arrays([b.column("k").cast(pa.int64()), ids, pa.nulls(len(ids), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([n.tobytes()], pa.binary())], names=names)

    return mapped(df.select(F.col("doc_id").alias("k"), F.col("text").cast("binary").alias("t")), run, "doc_id long, ids binary, counts binary")


def id_counts(counts: DataFrame, size: int) -> np.ndarray:
    """The sum of all rows' counts; what reaches the driver is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("counts").to_pylist():
                n += np.frombuffer(x, np.int64)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for id_, n in mapped(counts.select("counts"), run, "id int, n long").groupBy("id").agg(F.sum("n")).collect():
        out[id_] = n
    return out


def _crc(freqs: np.ndarray) -> int:
    return zlib.crc32(freqs.astype("<u4").tobytes())


def write_blocks(ids: DataFrame, freqs: np.ndarray, path: str) -> None:
    """Writes the blocks under ``path``: whole documents in each, parts and blocks ascending by document id.

    Documents are dealt by ranges of doc_id (nulls first; rows of one id ascend by a hash of their ids, and those of one
    id with equal ids are dealt by their place, so no id is one task's alone) and each task writes one part. A document
    of any length is in one block; its segments are coded a few at a time.
    """
    raw, table_crc = freqs.astype("<u4").tobytes(), _crc(freqs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = Coder(np.frombuffer(raw, "<u4")), TaskContext.get().partitionId()
        block, done, docs, held = 0, 0, [], []

        def out() -> pa.RecordBatch:
            sizes = [len(x) // 2 for x in held]
            all_ids = np.frombuffer(b"".join(held), np.uint16)
            row = (part, block, done, docs, sizes, len(all_ids), table_crc, coder.encode(all_ids))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _FILE_TYPES)], names=_FILE_NAMES)

        size = 0
        for b in batches:
            for k, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                docs.append(k)
                held.append(x)
                size += len(x) // 2
                if size >= BLOCK_IDS:
                    yield out()
                    block, done, docs, held, size = block + 1, done + size, [], [], 0
        if docs:
            yield out()

    x = ids.select("doc_id", "ids", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("at"))
    dealt = x.repartitionByRange(width(ids.sparkSession), "doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at").select("doc_id", "ids")
    mapped(dealt, run, FILE_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")


def write_table(spark: SparkSession, freqs: np.ndarray, path: str) -> None:
    """Writes the shared frequencies under ``path``, without which no block can be decoded."""
    row = (bytearray(freqs.astype("<u4").tobytes()), _crc(freqs))
    spark.createDataFrame([row], TABLE_SCHEMA).coalesce(1).write.option("compression", "zstd").parquet(f"{path}/table")


def read_table(spark: SparkSession, path: str) -> np.ndarray:
    """The shared frequencies that belong to the files under ``path``."""
    raw, crc = spark.read.schema(TABLE_SCHEMA).parquet(f"{path}/table").head()
    freqs = np.frombuffer(bytes(raw), "<u4")
    if _crc(freqs) != crc:
        raise Corrupt("the frequency table's checksum differs")
    return freqs


def _decoded(spark: SparkSession, path: str, run: Callable, schema: str) -> DataFrame:
    """Rows that ``run`` makes of each document (doc_id, start, ids) of the files under ``path``.

    What the driver holds is one number for each part, and the frequencies.
    """
    blocks = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/blocks")
    before, at = {}, 0
    for part, n in sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect()):
        before[part] = at
        at += n
    freqs = read_table(spark, path)
    raw, table_crc = freqs.tobytes(), _crc(freqs)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(np.frombuffer(raw, "<u4"))
        for b in batches:
            for i in range(len(b)):
                part, start, docs, sizes, crc, data = (b.column(c)[i].as_py() for c in ("part", "start_in_part", "doc_ids", "doc_sizes", "table_crc", "data"))
                if crc != table_crc:
                    raise Corrupt("the block was written with another frequency table")
                ends = np.cumsum(sizes)
                yield run(docs, before[part] + start + ends - sizes, ends - sizes, ends, coder.decode(data))

    return mapped(blocks.select("part", "start_in_part", "doc_ids", "doc_sizes", "table_crc", "data"), decode, schema)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files under ``path`` alone."""

    def run(docs: list, starts: np.ndarray, at: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        raw = memoryview(ids.astype("<u4").tobytes())
        crcs = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at.tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, starts, ends - at, crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _decoded(spark, path, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, ids) of every document, ids as an array, decoded from the files under ``path`` alone."""

    def run(docs: list, starts: np.ndarray, at: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(at, ends[-1:]), pa.int64()), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), lists], names=["doc_id", "start", "ids"])

    return _decoded(spark, path, run, "doc_id long, start long, ids array<int>")


def store_tokens(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Token files of all documents under ``path``, a new directory: ``blocks`` and the shared ``table``, enough to decode them in any session.

    A null text has the end id alone. Null ids come first. Rows of one id stay separate documents. An empty table gives
    empty files. Other columns aren't read.
    """
    vocabulary = vocabulary or vocabulary_path()
    found = written(counted(docs, vocabulary))
    freqs = shared_table(id_counts(found.filter("counts IS NOT NULL"), encoder(vocabulary).size))
    write_table(docs.sparkSession, freqs, path)
    write_blocks(found.filter("counts IS NULL").select("doc_id", "ids"), freqs, path)


def token_index(docs: DataFrame, path: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Writes the token files of all documents and reads them back, as ``read_blocks`` returns them.

    Without a ``path`` they are in the shared folder and go when the session ends. Cases are as in ``store_tokens``.
    """
    path = path or scratch(docs.sparkSession)
    store_tokens(docs, path, vocabulary)
    return read_blocks(docs.sparkSession, path)
