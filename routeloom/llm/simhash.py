"""SimHash near-duplicate groups by deletion-variant signatures.

A document's fingerprint has 64 bits: the majority over the XXH64 values of its word
shingles. Two fingerprints are linked when they differ in at most `max_bits` bits.

The 64 bits are cut into so few segments that at most one bit can differ in the best
one: with s segments and at most 2 s - 1 differing bits, some segment differs in at
most one bit. Each fingerprint is indexed under every segment with one of its bits
taken out (a wildcard), so two such segments meet under the wildcard of the bit in
which they differ (or under any, if equal). Rows that meet under one key are verified
on all 64 bits. The self-join on the key is evaluated on rows sorted by the key inside
hash partitions, which lets equal keys be reduced to a spanning forest of their links
at once: rows made stay in proportion to the fingerprints even inside a huge group of
copies, where a plain join would make the square of the group.

Keys that more than `bucket_rows` fingerprints share are not compared in one task: they
are dealt again as pairs of blocks of the bucket, each pair to its own group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_worker, keyed_texts, parallelism
from .components import components

BITS = 64
SEED = 42
#: Shingles whose bits are counted at once; bounds the memory a long text takes.
SHINGLES_AT_ONCE = 1 << 18


def fingerprint(text: str, shingle_words: int = 4) -> int:
    """The unsigned fingerprint of one text; 0 without a word."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space divides
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle_words:
        starts, ends = starts[: 1 - shingle_words or None], ends[shingle_words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), SHINGLES_AT_ONCE):
        part = slice(k, k + SHINGLES_AT_ONCE)
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[part].tolist(), ends[part].tolist())], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle_words) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(in_worker(run), "doc_id bigint, fp bigint")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the fewest segments of which one differs by at most one bit."""
    n = max(1, (max_bits + 2) // 2)
    bounds = [round(i * BITS / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def _variants(fps: DataFrame, max_bits: int) -> DataFrame:
    """(key, fp): 64 rows for each fingerprint. The key holds the bit taken out and the rest of its segment."""
    keys = []
    for shift, width in segments(max_bits):
        for bit in range(width):
            mask = ((1 << width) - 1) & ~(1 << bit)
            # 2^6 wildcards; a segment of more than 57 bits (max_bits < 2) is hashed, which verification allows
            rest = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint"))
            if width > 57:
                rest = F.xxhash64(rest).bitwiseAND(F.lit((1 << 57) - 1))
            keys.append(F.shiftleft(rest, 6).bitwiseOR(F.lit(shift + bit).cast("bigint")))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the fingerprints of one bucket, found by searching outwards from each."""
    left, kids, parents = fps, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _popcount(left ^ at) <= max_bits
            if near.any():
                found = left[near]
                kids.append(found)
                parents.append(np.full(len(found), at))
                queue.extend(found)
                left = left[~near]
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *kids]), np.concatenate([empty, *parents])


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as edges a-b have, as edges from each node to the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hook the larger root to the smaller one, then shorten all paths
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            break
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root != root[root]).any():
            root = root[root]
    off = root != np.arange(len(nodes))
    return nodes[off], nodes[root[off]]


def _compare(max_bits: int, bucket_rows: int):
    """Over rows sorted by key: links as (a, b, key null); of buckets that are too large (null, null, key)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])

    def run(batches):
        rest_key, rest_fp = np.empty(0, np.int64), np.empty(0, np.int64)
        large, links_a, links_b, held = set(), [], [], 0

        def work(key, fp):
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(edge, len(key)))
            few = (size > 1) & (size <= 32)
            at = np.repeat(edge[few] + size[few], size[few])  # the end of each row's bucket
            row = np.concatenate([np.empty(0, np.int64), *([np.repeat(edge[few], size[few]) + (np.arange(len(at)) - np.repeat(np.cumsum(size[few]) - size[few], size[few]))] if few.any() else [])])
            for lag in range(1, 32):
                inside = row + lag < at
                row, at = row[inside], at[inside]
                if not len(row):
                    break
                near = _popcount(fp[row] ^ fp[row + lag]) <= max_bits
                yield fp[row[near]], fp[row[near] + lag]
            for s, n in zip(edge[size > 32].tolist(), size[size > 32].tolist()):
                if n > bucket_rows:
                    large.add(int(key[s]))
                else:
                    yield _forest(fp[s : s + n], max_bits)

        def emit():
            a, b = _merged(np.concatenate([np.empty(0, np.int64), *links_a]), np.concatenate([np.empty(0, np.int64), *links_b]))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], schema=schema)

        def ready(key, fp):
            nonlocal held
            for a, b in work(key, fp):
                links_a.append(a)
                links_b.append(b)
                held += len(a)

        for batch in batches:
            key = np.concatenate([rest_key, batch.column(0).to_numpy()])
            fp = np.concatenate([rest_fp, batch.column(1).to_numpy()])
            if not len(key):
                continue
            if int(key[-1]) in large:  # the rest of a bucket that is too large isn't gathered
                go_on = key != key[-1]
                key, fp = key[go_on], fp[go_on]
                last = len(key)
            else:
                last = int(np.searchsorted(key, key[-1]))
                if len(key) - last > bucket_rows:
                    large.add(int(key[-1]))
                    key, fp = key[:last], fp[:last]
            rest_key, rest_fp = key[last:], fp[last:]
            if last:
                ready(key[:last], fp[:last])
            if held > 1 << 20:
                yield emit()
                links_a, links_b, held = [], [], 0
        if len(rest_key):
            ready(rest_key, rest_fp)
        if held:
            yield emit()
        if large:
            keys = pa.array(sorted(large), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.int64()), keys], schema=schema)

    return run


def _block_links(max_bits: int):
    """The links between two blocks of one bucket (or within one)."""

    def run(key, rows):
        a, b = _forest(np.unique(rows.column("fp").to_numpy()), max_bits)
        return pa.table({"a": a, "b": b})

    return run


def links(fps: DataFrame, max_bits: int = 4, bucket_rows: int = 8192) -> DataFrame:
    """fps(fp), distinct -> (a, b): edges that have the same components as all pairs of at most max_bits differing bits."""
    spark = fps.sparkSession
    variants = _variants(fps, max_bits)
    met = cut(
        variants.repartition(parallelism(spark), "key")
        .sortWithinPartitions("key")
        .mapInArrow(in_worker(_compare(max_bits, bucket_rows)), "a bigint, b bigint, key bigint")
    )
    found, hot = met.where("a is not null").select("a", "b"), met.where("key is not null").select("key").distinct()
    if hot.isEmpty():
        return found
    # Hot buckets: blocks of half a bucket's allowance; every pair of blocks is a group of its own.
    rows = cut(variants.join(hot, "key", "left_semi"))
    blocks = rows.groupBy("key").count().select("key", F.ceil(F.col("count") * 2 / bucket_rows).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        rows.join(blocks, "key")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    return found.union(dealt.groupBy("key", "i", "j").applyInArrow(_block_links(max_bits), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id, component_size.

    component_id is the smallest doc_id that links reach, the row's own included.
    Null and empty texts, and texts of white space, have fingerprint 0 and are linked like any other; texts shorter than a
    shingle are one shingle. Rows with a null id get the component's smallest id, or null where no row of it has one.
    Repeated rows are each returned. An empty table gives an empty result. Other columns are ignored.
    """
    fp = cut(fingerprints(docs, id_col, text_col, shingle_words))
    classes = cut(fp.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows")))
    roots = components(links(classes.select("fp"), max_bits))
    member = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least_id", "rows", F.coalesce("root", "fp").alias("root"))
    member = cut(member)
    groups = member.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("rows").alias("component_size"))
    of_fp = member.select("fp", "root").join(groups, "root").select("fp", "component_id", "component_size")
    return fp.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size"
    )
