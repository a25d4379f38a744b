"""Groups of near copies by the Jaccard similarity of word shingles: candidates by deletion variants of a long SimHash, verified exactly.

A text is the set of its word shingles (as in operator 1, of five words). Its SimHash has 1,280 bits, of which the first 640
are cut into segments of twenty. As in operator 1, a segment is indexed under each of its deletion variants (one bit taken
out), so two segments meet that differ in at most one bit. Texts with a similarity of 0.8 differ in about 15 % of the bits, so
they meet in a segment with a probability of 0.175, and in one of 32 with 0.998. Rows that meet under a variant are near when
the first 128 bits differ in at most `MAX_BITS`; texts that share no more than chance differ in 64. Texts that links of near
rows join are a family; tasks merge their links to a forest, in two rounds, so that few rows say which texts are a family.

The bit taken out lies in one half of the segment, and the other half is equal. So a row is dealt under each half of a
segment, and its variants in the other half are made where it arrives: twice a segment, not twenty times.

Within a family the shingle sets decide, of all pairs whose sizes allow the similarity and whose fingerprints differ in few
enough of all bits. A task compares two blocks of a family and gives a forest of the links found, so no row is made for a
pair. Its work grows with the square of a family; a node is dealt once for each block of its family.

Texts with the same set are one node. Halves that too many rows share are dealt again by variants; variants that more than
`bucket_rows` share are dealt again as pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_worker, parallelism, stored
from .components import components
from .simhash import SEED, _merged

WORDS = 20
#: Segments with variants, and the bits of half a segment.
SEGMENTS, HALF = 32, 10
#: Rows that share a half and are gathered, for each row that a variant's bucket may have.
GATHERED = 16
#: Of the first 128 bits; a pair with a similarity of 0.8 has 19 on average, with a deviation of 4.
MAX_BITS = 34
#: Of all bits, four deviations above the mean of a pair at 0.8: 194 for large sets and 206 at worst, but 240 for sets of four and five shingles.
MAX_ALL, MAX_ALL_TINY, TINY = 260, 296, 5
#: Buckets up to this size are compared whole at once.
SMALL = 32
#: Nodes, and shingles, of a family's block.
BLOCK_NODES, BLOCK_SHINGLES = 512, 500_000


def shingle_set(text: str, shingle_words: int = 5) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes; a text with fewer words is one shingle, without a word none."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle_words:
        starts, ends = starts[: 1 - shingle_words or None], ends[shingle_words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEPS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def long_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The majority over the bits that each shingle's hash is stretched to."""
    ones = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(shingles), 255):  # so that counts fit a byte
        h = _mixed(shingles[k : k + 255, None] + _STEPS)
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles)).view(np.int64)


def _keys(fps: np.ndarray) -> np.ndarray:
    """Of each row of fingerprint bytes, a key for each half of a segment: its number, its bits, and those of the other half."""
    bits = np.unpackbits(fps, axis=1)[:, : SEGMENTS * 2 * HALF].reshape(len(fps), 2 * SEGMENTS, HALF)
    values = bits.astype(np.int64) @ (1 << np.arange(HALF, dtype=np.int64))
    halves = np.arange(2 * SEGMENTS)
    return (halves << 2 * HALF) | (values << HALF) | values[:, halves ^ 1]


def _variant(key: np.ndarray, bit: int) -> np.ndarray:
    """The deletion variant of keys without a bit of the other half."""
    return (key & ~(1 << bit)) << 4 | bit


def _printed(shingle_words: int):
    def run(batches):
        for batch in batches:
            nodes, fps, sizes = [], [], []
            for t in batch.column(2):
                s = shingle_set(t.as_py(), shingle_words)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0)
                fps.append(long_fingerprint(s))
                sizes.append(len(s))
            found = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(fps, pa.list_(pa.int64())), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], ["doc_id", "h", "node", "fp", "size"])

    return run


def _dealt(batches):
    """A row for each half of a segment of each node: (key, node, c0, c1), the last two the bits to compare."""
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            fps = np.ascontiguousarray(part.column(1).flatten().to_numpy()).reshape(-1, WORDS)
            check = fps[:, :2]
            keys = _keys(fps.view(np.uint8))
            n = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(c, n)) for c in (part.column(0).to_numpy(), check[:, 0], check[:, 1]))], ["key", "node", "c0", "c1"])


def _bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits differ, for rows (c0, c1)."""
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _forest(check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of at most MAX_BITS that join whatever such links join."""
    left, out_a, out_b = np.arange(len(check)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _bits(check[left], check[at]) <= MAX_BITS
            if near.any():
                found, left = left[near], left[~near]
                out_a.append(found)
                out_b.append(np.full(len(found), at))
                queue.extend(found)
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


def _variants(batches):
    """A row for each variant of each row."""
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            part = batch.slice(k, 4096)
            key = part.column(0).to_numpy()
            keys = np.concatenate([_variant(key, bit) for bit in range(HALF)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.concat_arrays([part.column(c)] * HALF) for c in range(1, 4))], part.schema.names)


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])
_FOUND_TYPE = "a bigint, b bigint, key bigint"
#: Links that a task holds before it merges them.
HELD = 1 << 20


class _Links:
    """Links that are merged to a forest when many are held."""

    def __init__(self):
        self.a, self.b, self.count = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray):
        self.a.append(a)
        self.b.append(b)
        self.count += len(a)
        if self.count > HELD:
            yield self.forest()

    def forest(self) -> pa.RecordBatch:
        a, b = _merged(np.concatenate([np.empty(0, np.int64), *self.a]), np.concatenate([np.empty(0, np.int64), *self.b]))
        self.a, self.b, self.count = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], schema=_FOUND)


def _merge(batches):
    """A forest of links (a, b)."""
    links = _Links()
    for batch in batches:
        yield from links.add(batch.column(0).to_numpy(), batch.column(1).to_numpy())
    yield links.forest()


def _merged_links(links: DataFrame) -> DataFrame:
    """A forest of each task's links (a, b)."""
    return links.mapInArrow(in_worker(_merge), _FOUND_TYPE).select("a", "b")


def _fewer(links: DataFrame) -> DataFrame:
    """Of checkpointed links: links of a family are found in many tasks, and some of these together need no more rows than one."""
    return _merged_links(links.coalesce(1 + math.isqrt(links.rdd.getNumPartitions())))


def _of_pairs(dealt: DataFrame, by: str, compare: Callable) -> DataFrame:
    """The links of pairs of blocks: a forest of each task's, as the forests of all pairs would grow with the square of a group."""
    return cut(_merged_links(dealt.groupBy(by, "i", "j").applyInArrow(compare, "a bigint, b bigint")))


def _compare(bucket_rows: int, shift: int):
    """Over rows sorted by key: a forest of the near nodes as (a, b, null); of buckets that are too large (null, null, bucket).

    With a shift of 0 rows come by variants and a bucket is a variant. Else it is a key without its last bits, those of the other
    half: its rows are compared under each variant, and it is too large if one of its variants is, or if it can't be gathered.
    """
    most = bucket_rows * GATHERED if shift else bucket_rows

    def work(key, node, c0, c1, over):
        """The links within equal keys."""
        check = np.stack([c0, c1], axis=1)
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(edge, len(key)))
        row = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
        end = np.repeat(edge + size, size)[row]
        for lag in range(1, SMALL):
            inside = row + lag < end
            row, end = row[inside], end[inside]
            if not len(row):
                break
            near = _bits(check[row], check[row + lag]) <= MAX_BITS
            yield node[row[near]], node[row[near] + lag]
        for s, n in zip(edge[size > SMALL].tolist(), size[size > SMALL].tolist()):
            if n > bucket_rows:
                over.add(int(key[s]) >> shift)
                continue
            x, y = _forest(check[s : s + n])
            yield node[s + x], node[s + y]

    def run(batches):
        rest = [np.empty(0, np.int64)] * 4
        over, links = set(), _Links()

        def done(rows):
            if not shift:
                ordered = [rows]
            else:  # the bit taken out is zero in all
                cleared = ((rows[0] & ~(1 << bit), *rows[1:]) for bit in range(HALF))
                ordered = ([c[o] for c in rows] for rows in cleared for o in [np.argsort(rows[0], kind="stable")])
            for part in ordered:
                for a, b in work(*part, over):
                    yield from links.add(a, b)

        for batch in batches:
            rows = [np.concatenate([r, batch.column(k).to_numpy()]) for k, r in enumerate(rest)]
            if not len(rows[0]):
                continue
            bucket = rows[0] >> shift
            if int(bucket[-1]) in over:  # the rest of a bucket that is too large isn't gathered
                rows = [c[bucket != bucket[-1]] for c in rows]
                last = len(rows[0])
            else:
                last = int(np.searchsorted(bucket, bucket[-1]))
                if len(bucket) - last > most:
                    over.add(int(bucket[-1]))
                    rows = [c[:last] for c in rows]
            rest = [c[last:] for c in rows]
            if last:
                yield from done([c[:last] for c in rows])
        if len(rest[0]):
            yield from done(rest)
        yield links.forest()
        if over:
            n = len(over)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(sorted(over), pa.int64())], schema=_FOUND)

    return run


def _of_blocks(key, rows):
    """A forest of the near nodes of two blocks of a bucket (or one)."""
    node, one = np.unique(rows.column("node").to_numpy(), return_index=True)
    x, y = _forest(np.stack([rows.column(c).to_numpy()[one] for c in ("c0", "c1")], axis=1))
    return pa.table({"a": node[x], "b": node[y]})


def _dealt_in_pairs(rows: DataFrame, by: str, blocks: DataFrame) -> DataFrame:
    """rows with own, the block of a node, and i <= j, a pair of blocks; blocks(by, blocks) is their number.

    Dealt by all three: a grouping takes rows that the join has dealt by `by` as they are, and would have all pairs in one task.
    """
    return (
        rows.join(blocks, by)
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .repartition(by, "i", "j")
    )


def _met(rows: DataFrame, bucket: Column, compare: Callable) -> tuple[DataFrame, DataFrame | None]:
    """The links of rows that meet in a bucket, and the rows of buckets that are too large, if there are any."""
    met = rows.repartition(parallelism(rows.sparkSession), bucket).sortWithinPartitions("key").mapInArrow(in_worker(compare), _FOUND_TYPE)
    met = cut(met)
    hot = met.where("key is not null").select(F.col("key").alias("bucket")).distinct()
    large = None if hot.isEmpty() else cut(rows.join(hot, bucket == F.col("bucket"), "left_semi"))
    return met.where("a is not null").select("a", "b"), large


def _similar(similarity: float):
    """A forest of the links between two blocks of a family (or within one): the sets are compared of pairs not yet joined."""

    def run(key, rows):
        node, size, own = (rows.column(c).to_numpy() for c in ("node", "size", "own"))
        fps = rows.column("fp").combine_chunks().flatten().to_numpy().reshape(-1, WORDS)
        sets = rows.column("s").combine_chunks()
        edge, values = sets.offsets.to_numpy(), sets.values.to_numpy()
        root = np.arange(len(node))
        out = []
        for x in range(len(node) - 1):
            y = np.arange(x + 1, len(node))
            fits = np.minimum(size[y], size[x]) >= similarity * np.maximum(size[y], size[x])
            y = y[fits & (root[y] != root[x]) & ((own[y] != own[x]) | (key[1].as_py() == key[2].as_py()))]
            bits = np.bitwise_count((fps[y] ^ fps[x]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            most = np.where(np.maximum(size[y], size[x]) <= TINY, MAX_ALL_TINY, MAX_ALL)
            y, bits = y[bits <= most], bits[bits <= most]
            for other in y[np.argsort(bits, kind="stable")].tolist():
                if root[other] == root[x]:
                    continue
                common = len(np.intersect1d(values[edge[x] : edge[x + 1]], values[edge[other] : edge[other + 1]], assume_unique=True))
                if common >= similarity * (size[x] + size[other] - common):
                    out.append((node[x], node[other]))
                    root[root == root[other]] = root[x]
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    return run


def _sets(shingle_words: int):
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # sets take more room than texts
                part = batch.slice(k, 256)
                found = [shingle_set(t.as_py(), shingle_words).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("family", "node", "fp", "size")), pa.array(found, pa.list_(pa.int64()))], ["family", "node", "fp", "size", "s"])

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, bucket_rows: int = 8192) -> DataFrame:
    """One row for each row of docs: doc_id, h (hash of the text), component_id, component_size, stays.

    Rows are linked when the Jaccard similarity of their shingles is at least `similarity`; component_id is the smallest
    doc_id that links reach. stays holds for the rows with that id and, of these, the least h: one row of a component, and those
    that repeat its id and text. Keys are made for similarities of 0.8 and more: lower ones are found less often. Texts without
    a word are linked with each other only. Null ids, repeated rows and empty tables are as for operator 1.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    prints = stored(rows.mapInArrow(in_worker(_printed(shingle_words)), "doc_id bigint, h bigint, node bigint, fp array<bigint>, size int"), "near-prints")
    nodes = stored(prints.where("node <> 0").groupBy("node").agg(F.first("fp").alias("fp"), F.first("size").alias("size")), "near-nodes")
    keyed = nodes.select("node", "fp").mapInArrow(in_worker(_dealt), "key bigint, node bigint, c0 bigint, c1 bigint")
    half = F.shiftright("key", HALF)
    near, large = _met(keyed, half, _compare(bucket_rows, HALF))
    if large is not None:
        by_variant = large.mapInArrow(in_worker(_variants), keyed.schema)
        found, large = _met(by_variant, F.col("key"), _compare(bucket_rows, 0))
        near = near.union(found)
    if large is not None:
        blocks = large.groupBy("key").count().select("key", F.ceil(F.col("count") * 2 / bucket_rows).cast("int").alias("blocks"))
        near = near.union(_of_pairs(_dealt_in_pairs(large, "key", blocks), "key", _of_blocks))
    families = components(_fewer(near)).withColumnRenamed("root", "family")
    # one text of each node: those with the same set need not be the same text
    one = nodes.join(families, "node").join(prints.groupBy("node").agg(F.min("h").alias("h")), "node")
    members = rows.select("h", "text").join(one, "h").dropDuplicates(["node"]).select("family", "node", "fp", "size", "text")
    members = stored(members.mapInArrow(in_worker(_sets(shingle_words)), "family bigint, node bigint, fp array<bigint>, size int, s array<bigint>"), "near-sets")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    dealt = _dealt_in_pairs(members, "family", members.groupBy("family").agg(blocks))
    roots = components(_fewer(_of_pairs(dealt, "family", _similar(similarity))))
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")  # rows without an id come last
    classes = prints.groupBy("node").agg(F.min(own).alias("least"), F.count("*").alias("rows"))
    member = cut(classes.join(roots, "node", "left").select("node", "least", "rows", F.coalesce("root", "node").alias("root")))
    groups = member.groupBy("root").agg(F.min("least").alias("least"), F.sum("rows").alias("component_size"))
    of_node = member.select("node", "root").join(groups, "root").select("node", "least", "component_size")
    return prints.join(of_node, "node").select("doc_id", "h", F.col("least.doc_id").alias("component_id"), "component_size", own.eqNullSafe(F.col("least")).alias("stays"))
