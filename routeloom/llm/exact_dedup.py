"""Exact duplicates by an extendible-hash index on shared files.

A text's key is the 64-bit hash of its normalised form. The directory maps leading bits of
the key to buckets. It starts as one bucket of no bits. A bucket whose texts exceed its
capacity is split by one more bit, and the directory doubles when the bucket already has
all the bits of the directory; a bucket with a single key can't be split and is only
longer. Entries of one bucket are adjacent, so the directory is kept as the first key and
the bits of each bucket.

Buckets are ranges of keys, and each owner task has a range of buckets. Its rows come in the
order of keys; texts with the same key form a chain in which bytes are compared, and each
different text of the chain is a class. Rows find their class by key and place in the chain;
only where a chain has several texts are the texts looked at again. The classes and the
directory are files in the shared folder: `Index.open` reads them again, `Index.probe`
looks up other texts.

Copies are folded within each reading task before anything is shuffled. The keys that more
than a ten-thousandth of all rows have (so at most 10,000 of them) are folded a second time
in 64 shares of the tasks, and rows with them meet their classes by a broadcast of these, so
that no task gets a hot text from every task. Memory of an owner is one chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_worker, keyed_texts, new_folder, parallelism, stored

#: Texts folded within a task before they are passed on.
FOLD_BYTES = 32 << 20
#: Rows of the index besides a text's bytes.
ROW_BYTES = 200
#: A key is hot if more rows than this share of all have it.
HOT_SHARE = 10_000
HOT_LEAST = 1000
SHARES = 64
#: Bits that one round of splitting looks ahead at most.
AHEAD = 16
CLASSES = "bucket bigint, key bigint, chain int, chains int, sha binary, keep_id bigint, group_size bigint"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def text_key(text: Column) -> Column:
    """The key of a normalised text."""
    return F.xxhash64(text)


@dataclass(frozen=True)
class Directory:
    """Bucket i begins at the unsigned key starts[i] and has depths[i] bits of its own; depth is the largest of them."""

    starts: np.ndarray
    depths: np.ndarray

    @property
    def depth(self) -> int:
        return int(self.depths.max(initial=0))

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, keys.view(np.uint64), side="right") - 1

    @classmethod
    def grown(cls, histogram: Callable[[list[int], int, int], dict[int, tuple[int, int]]], total: int, capacity: int) -> Directory:
        """Splits from one bucket on. histogram(prefixes, depth, bits) has bytes and keys by the first depth + bits bits, below buckets of `depth` bits."""
        done: list[tuple[int, int]] = []
        over, depth, largest = [0], 0, total
        if total <= capacity:
            done, over = [(0, 0)], []
        while over:
            bits = min(AHEAD, 64 - depth, max(1, int(np.ceil(np.log2(largest / capacity))) + 1))
            level = histogram(over, depth, bits)
            levels = [level]
            for _ in range(bits):  # what each bucket of fewer bits would hold
                above: dict[int, tuple[int, int]] = {}
                for prefix, (size, keys) in levels[-1].items():
                    s, k = above.get(prefix >> 1, (0, 0))
                    above[prefix >> 1] = (s + size, k + keys)
                levels.append(above)
            levels.reverse()  # levels[k]: by depth + k bits
            overfull, largest = [], 0
            todo = [(prefix, 0) for prefix in over]
            while todo:
                prefix, k = todo.pop()
                size, keys = levels[k].get(prefix, (0, 0))
                if size <= capacity or keys <= 1 or depth + k == 64:
                    done.append((prefix << (64 - depth - k), depth + k))
                elif k == bits:
                    overfull.append(prefix)
                    largest = max(largest, size)
                else:
                    todo += [(2 * prefix, k + 1), (2 * prefix + 1, k + 1)]
            over, depth = sorted(overfull), depth + bits
        done.sort()
        return cls(np.array([s for s, _ in done], np.uint64), np.array([d for _, d in done], np.int64))


@dataclass(frozen=True)
class Index:
    """The directory, and classes (see CLASSES): one row for each different text, in files by key range. chains is the length of its chain."""

    directory: Directory
    classes: DataFrame
    path: str = ""

    def write_directory(self, spark: SparkSession) -> None:
        rows = pa.table({"start": self.directory.starts.view(np.int64), "depth": self.directory.depths})
        spark.createDataFrame(rows).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/directory")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """The index in a folder that `build_index` has written."""
        rows = spark.read.parquet(f"{path}/directory").toArrow()
        starts = rows.column("start").to_numpy().view(np.uint64)
        order = np.argsort(starts)
        return cls(Directory(starts[order], rows.column("depth").to_numpy()[order]), spark.read.parquet(f"{path}/classes"), path)

    def probe(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row for each row of docs: doc_id, bucket, chain, keep_id, group_size of its text's class; all but doc_id and bucket are null if the index has no such text.

        The index keeps no texts: a class is met by key, then by SHA-256. Nulls are as for `duplicates`.
        """
        directory = self.directory

        def find(batches):
            for batch in batches:
                keys = batch.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(directory.bucket(keys), pa.int64())], ["doc_id", "key", "sha", "bucket"])

        text = keyed_texts(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("text"))
        rows = text.select("doc_id", text_key(F.col("text")).alias("key"), F.unhex(F.sha2("text", 256)).alias("sha"))
        rows = rows.mapInArrow(in_worker(find), "doc_id bigint, key bigint, sha binary, bucket bigint")
        return rows.join(self.classes.drop("chains"), ["bucket", "key", "sha"], "left").select("doc_id", "bucket", "chain", "keep_id", "group_size")


def _fold(batches):
    """The different texts of a task: (key, text, least_id, rows), from rows of the same kind."""
    names = ["key", "text", "least_id", "rows"]
    held: dict[tuple[int, bytes], list] = {}
    size = 0

    def emit():
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in held], pa.int64()), pa.array([t for _, t in held], pa.binary()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], names
        )

    for batch in batches:
        for key, value, least, rows in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            text = value.as_py()
            if (found := held.get((key, text))) is None:
                held[key, text] = [least, rows]
                size += len(text) + ROW_BYTES
            else:
                found[1] += rows
                if least is not None and (found[0] is None or least < found[0]):
                    found[0] = least
            if size > FOLD_BYTES:
                yield emit()
                held, size = {}, 0
    if held:
        yield emit()


def _placed(directory: Directory, owner_of: np.ndarray):
    """Adds the bucket and its owner."""

    def run(batches):
        for batch in batches:
            bucket = directory.bucket(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(owner_of[bucket], pa.int32()), pa.array(bucket, pa.int64()), *batch.columns], ["owner", "bucket", "key", "text", "least_id", "rows"])

    return run


def _own(batches):
    """An owner's rows (owner, bucket, key, text, least_id, rows) by key: chains of different texts with the same key; bytes decide."""
    names = ["bucket", "key", "chain", "chains", "sha", "keep_id", "group_size"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    at, chain, out = None, [], []

    def close():
        out.extend((*at, n, len(chain), hashlib.sha256(text).digest(), least, rows) for n, (text, least, rows) in enumerate(chain))

    def emit():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    for batch in batches:
        for bucket, key, value, least, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist()):
            if (bucket, key) != at:
                if at is not None:
                    close()
                at, chain = (bucket, key), []
            text = value.as_py()
            for c in chain:
                if c[0] == text:
                    c[1] = least if c[1] is None else c[1] if least is None else min(c[1], least)
                    c[2] += rows
                    break
            else:
                chain.append([text, least, rows])
        if len(out) > 1 << 14:
            yield emit()
            out = []
    if at is not None:
        close()
    if out:
        yield emit()


def _directory(keys: DataFrame, capacity: int) -> Directory:
    """keys(key, size, n): the directory of the different texts."""

    def histogram(over: list[int], depth: int, bits: int) -> dict[int, tuple[int, int]]:
        rows = keys
        if depth:  # at most as many buckets as capacity divides the bytes into
            signed = [p - (1 << 64) if p >> 63 else p for p in over]
            some = keys.sparkSession.createDataFrame(pa.table({"p": pa.array(signed, pa.int64())}))
            rows = keys.join(F.broadcast(some), F.shiftrightunsigned("key", 64 - depth) == F.col("p"), "left_semi")
        prefix = F.shiftrightunsigned("key", 64 - depth - bits).alias("prefix")
        found = rows.groupBy(prefix).agg(F.sum(F.col("size") + ROW_BYTES).alias("b"), F.count("*").alias("k")).toArrow()
        return {p % (1 << 64): (b, k) for p, b, k in zip(*(found.column(c).to_pylist() for c in ("prefix", "b", "k")))}

    total = keys.agg(F.coalesce(F.sum(F.col("size") + ROW_BYTES), F.lit(0))).first()[0]
    return Directory.grown(histogram, total, capacity)


def _index(texts: DataFrame, keys: DataFrame, hot: DataFrame, bucket_bytes: int, path: str) -> Index:
    """texts(doc_id, key, text), keys(key, size, n), hot(key)."""
    spark = texts.sparkSession
    directory = _directory(keys, bucket_bytes)
    # enough owners for the ranges, whatever the session's default is
    owners = min(len(directory.starts), max(parallelism(spark), -(-len(directory.starts) // 4)))
    owner_of = np.arange(len(directory.starts)) * owners // len(directory.starts)
    kind = "key bigint, text binary, least_id bigint, rows bigint"
    rows = texts.select("key", F.col("text").cast("binary"), F.col("doc_id").alias("least_id"), F.lit(1).cast("bigint").alias("rows"))
    few, many = rows.join(F.broadcast(hot), "key", "left_anti"), rows.join(F.broadcast(hot), "key", "left_semi")  # at most HOT_SHARE keys
    share = (F.spark_partition_id() % SHARES).alias("share")
    twice = many.mapInArrow(in_worker(_fold), kind).withColumn("share", share).repartition(parallelism(spark), "key", "share").drop("share").mapInArrow(in_worker(_fold), kind)
    folded = few.mapInArrow(in_worker(_fold), kind).union(twice).mapInArrow(_placed(directory, owner_of), f"owner int, bucket bigint, {kind}")
    owned = folded.repartitionById(owners, "owner").sortWithinPartitions("key").mapInArrow(in_worker(_own), CLASSES)
    owned.write.parquet(f"{path}/classes")
    index = Index(directory, spark.read.schema(CLASSES).parquet(f"{path}/classes"), path)
    index.write_directory(spark)
    return index


def _hot(keys: DataFrame) -> DataFrame:
    """The keys of more than a share of all rows: at most HOT_SHARE."""
    rows = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = keys.where(F.col("n") > max(HOT_LEAST, rows // HOT_SHARE)).select("key").toArrow()
    return keys.sparkSession.createDataFrame(found)


def _parts(docs: DataFrame, id_col: str, text_col: str, key: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts(doc_id, key, text), keys(key, size, n) and the hot keys. keys has a row for each different key."""
    texts = keyed_texts(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("text")).select("doc_id", key(F.col("text")).alias("key"), "text")
    keys = stored(texts.groupBy("key").agg(F.max(F.octet_length("text")).alias("size"), F.count("*").alias("n")), "exact-keys")
    return texts, keys, _hot(keys)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 32 << 20, key: Callable[[Column], Column] = text_key) -> Index:
    """Write the index of a table of documents into a folder of the shared store, for Index.open. `key` gives the key of a normalised text; probes take text_key."""
    return _index(*_parts(docs, id_col, text_col, key), bucket_bytes, path)


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 32 << 20, key: Callable[[Column], Column] = text_key) -> DataFrame:
    """One row for each row of docs: doc_id, key (of the normalised text), keep_id, group_size, kept, text_sha256 (of the normalised text), bucket, chain.

    Texts are equal when identical after each run of ASCII white space is replaced by one space; a null text is empty.
    The row with the smallest doc_id stays. Rows with a null id never stay unless all of a group have one; then keep_id is null
    and all stay, as they can't be told apart. Rows that repeat both id and text are the same document: each is returned
    and kept. An empty table gives an empty result. Other columns are ignored. The directory has an entry for each bucket of
    at most bucket_bytes, on the driver and in the tasks: some 27 MB for 50 TB of different texts.
    """
    spark = docs.sparkSession
    texts, keys, hot = _parts(docs, id_col, text_col, key)
    classes = _index(texts, keys, hot, bucket_bytes, new_folder(spark, "exact-index")).classes
    rows, single = texts.drop("text"), classes.where("chains = 1")
    columns = [
        "doc_id", "key", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "chain",
    ]
    # one class for each hot key, at most HOT_SHARE
    of_hot = rows.join(F.broadcast(single.join(F.broadcast(hot), "key", "left_semi")), "key").select(*columns)
    of_others = rows.join(F.broadcast(hot), "key", "left_anti").join(single, "key").select(*columns)
    out = of_hot.union(of_others)
    collided = classes.where("chains > 1")
    if not collided.isEmpty():  # different texts with one key: the rows' texts decide
        again = texts.join(collided.select("key").distinct(), "key", "left_semi").select("doc_id", "key", F.unhex(F.sha2("text", 256)).alias("sha"))
        out = out.union(again.join(collided, ["key", "sha"]).select(*columns))
    return out
