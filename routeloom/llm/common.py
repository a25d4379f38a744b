"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Cut batches for Python workers by bytes: rows are whole texts, and a task holds a batch on either side and in the allocators' pools."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not re.fullmatch(r"\d+b?", now) or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that no other column can clash. A null text is empty."""
    bound_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on this machine may leave it unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jvm_dir.isDefined():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="routeloom-"))
            jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get()
    return found.rstrip("/")


#: Folders made by `stored` within each open `workspace`, and those that go when the program ends.
_open: list[list[str]] = []
_at_exit: dict[str, SparkSession] = {}


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _at_exit.pop(path, None)


@atexit.register
def _clear() -> None:
    for path, spark in list(_at_exit.items()):
        with contextlib.suppress(Exception):  # the session may have ended
            remove(spark, path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is removed with the open workspace, else at the end of the program."""
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _at_exit[path] = spark
    if _open:
        _open[-1].append(path)
    return path


@contextlib.contextmanager
def workspace(spark: SparkSession, *keep: str) -> Iterator[list[str]]:
    """Folders made inside are removed at its end, when what was computed from them has been written elsewhere. Paths put into the list it gives stay."""
    kept = list(keep)
    _open.append([])
    try:
        yield kept
    finally:
        for path in _open.pop():
            if path in kept:
                if _open:
                    _open[-1].append(path)
            else:
                remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read it again: smaller than a checkpoint for wide rows."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def in_worker(run: Callable, *own: type) -> Callable:
    """A function over Arrow batches that leaves the Python worker small: caches of other operators are dropped first, free memory goes back at the end.

    `own` are classes whose `_kept` instances outlive a task within the worker.
    """
    names = [f"{c.__module__}.{c.__name__}" for c in own]

    def wrapped(batches):
        drop_caches(names)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


#: Classes with instances in `_kept`.
CACHES = ("language_id.Scorer", "word_tokens.WordEncoder", "bpe.Codec")


def drop_caches(but: list[str]) -> None:
    for name in CACHES:
        module, cls = name.split(".")
        full = f"{__package__}.{module}"
        if f"{full}.{cls}" not in but and full in sys.modules:
            getattr(sys.modules[full], cls)._kept.clear()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
