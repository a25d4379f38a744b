"""Token ids as binary files of independently decodable blocks, and reading them back.

Documents are dealt to ranges of ids, so that the tasks' files, in order, hold all ids in
ascending order of the documents. Each task encodes its documents and cuts their ids into
blocks of `block_ids`; a block has a table of the documents that have ids in it, a checksum
of its ids, and one of its bytes (see range_coder.pack for the layout). The blocks are the
rows of Parquet files in the shared folder, which any store that Spark writes to can hold;
(task, block) orders them. Each block is read and checked without any other.

Blocks are coded in the JVM by BlockCoder.java, which gives the bytes of range_coder.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jvm, range_coder
from .common import cut, in_worker, keyed_texts, new_folder, parallelism
from .word_tokens import WordEncoder, encoded

#: Blocks that go from a Python worker to the JVM at once.
BATCH_BLOCKS = 128
CODER = "BlockCoder.java"
PARTS = "array<struct<place: int, before: int, doc_id: bigint, n: int, crc: bigint, first: boolean, last: boolean>>"

CRC_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials over bits modulo CRC-32's, lowest power in the highest bit."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (CRC_POLYNOMIAL if b & 1 else 0)
    return out


@lru_cache(1 << 14)
def _shift(n: int) -> int:
    """x to the power of the bits of n bytes."""
    shift, power = 1 << 31, 1 << 23  # x^0, and x^8 for one byte
    while n:
        if n & 1:
            shift = _times(shift, power)
        power = _times(power, power)
        n >>= 1
    return shift


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """The CRC-32 of two stretches of bytes, from those of each and the second's length."""
    return _times(_shift(second_bytes), first) ^ second


def _encode(path: str, end_id: int, block_ids: int):
    names = ["task", "block", "start", "n_ids", "table", "ids"]

    def run(batches):
        encoder, task = WordEncoder.of(path), TaskContext.get().partitionId()
        end = int(end_id).to_bytes(4, "little")
        entry = range_coder.ENTRY.pack
        block, full, table, ids_of, room = 0, [], [], [], block_ids

        def emit():
            nonlocal block
            tables, ids = zip(*full)
            n, start = len(full), range(block * block_ids, (block + len(full)) * block_ids, block_ids)
            out = [pa.array([task] * n, pa.int32()), pa.array(range(block, block + n), pa.int64()), pa.array(start, pa.int64()), pa.array([len(d) // 4 for d in ids], pa.int64()), pa.array(tables, pa.binary()), pa.array(ids, pa.binary())]
            block += n
            full.clear()
            return pa.RecordBatch.from_arrays(out, names)

        def close():
            nonlocal table, ids_of, room
            full.append((b"".join(table), b"".join(ids_of)))
            table, ids_of, room = [], [], block_ids

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for row, ids in encoded(batch, encoder):
                ids += end
                doc_id = doc_ids[row]
                at, n = 0, len(ids) // 4
                whose, has_id = (0, 0) if doc_id is None else (doc_id, range_coder.HAS_ID)
                while at < n:
                    take = min(room, n - at)
                    table.append(entry(whose, take, has_id | (at == 0) * range_coder.FIRST | (at + take == n) * range_coder.LAST))
                    ids_of.append(ids[4 * at : 4 * (at + take)])
                    at, room = at + take, room - take
                    if not room:
                        close()
                        if len(full) >= BATCH_BLOCKS:
                            yield emit()
        if table:
            close()
        if full:
            yield emit()

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, block_ids: int = 2048, files: int | None = None) -> None:
    """Write the ids of each text and an end id after it, in ascending order of the documents' ids.

    Null and empty texts have their end id only. Null ids come first; rows with the same id are ordered by their texts'
    hashes. An empty table writes no block. Other columns are ignored. Ids must be below 65536.
    """
    spark, texts = docs.sparkSession, keyed_texts(docs, id_col, text_col)
    order = texts.repartitionByRange(files or parallelism(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    blocks = order.mapInArrow(in_worker(_encode(tokenizer_path, end_id, block_ids), WordEncoder), "task int, block bigint, start bigint, n_ids bigint, table binary, ids binary")
    pack = jvm.function(spark, CODER, "routeloom.BlockCoder$Pack", "binary")
    blocks.select("task", "block", "start", "n_ids", pack("table", "ids").alias("data")).write.parquet(path)


def _join(batches):
    """Whole documents from their parts, which come in order: (task, start, doc_id, n_tokens, ids_crc32)."""
    names = ["task", "start", "doc_id", "n_tokens", "ids_crc32"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    begun = None
    for batch in batches:
        out = []
        for task, start, doc_id, n, crc, first, last in zip(*(batch.column(k).to_pylist() for k in range(7))):
            begun = [task, start, doc_id, n, crc] if first else [*begun[:3], begun[3] + n, joined_crc(begun[4], crc, 4 * n)]
            if last:
                out.append(begun)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def read(spark, path: str) -> DataFrame:
    """One row for each document written: doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files.

    A damaged block stops the read with an error.
    """
    unpack = jvm.function(spark, CODER, "routeloom.BlockCoder$Unpack", PARTS)
    blocks = spark.read.parquet(path).select("task", "block", "start", unpack("data").alias("parts"))
    # start: ids before a part in its file
    parts = blocks.selectExpr("task", "block", "start as block_start", "inline(parts)")
    parts = cut(parts.selectExpr("task", "block", "place", "block_start + before as start", "doc_id", "cast(n as bigint) as n", "crc", "first", "last"))
    whole = parts.where("first and last").selectExpr("task", "start", "doc_id", "n as n_tokens", "crc as ids_crc32")
    # documents over several blocks: a file's few such parts in order
    split = parts.where("not (first and last)").repartition("task").sortWithinPartitions("task", "block", "place")
    split = split.select("task", "start", "doc_id", "n", "crc", "first", "last").mapInArrow(_join, "task int, start bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    files = parts.groupBy("task").agg(F.sum("n").alias("ids")).selectExpr("task as t", "sum(ids) over (order by task rows unbounded preceding) - ids as before_file")
    out = whole.union(split).join(F.broadcast(files), F.col("task") == F.col("t"))
    return out.select("doc_id", (F.col("before_file") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def new_path(spark) -> str:
    return new_folder(spark, "token-files")
