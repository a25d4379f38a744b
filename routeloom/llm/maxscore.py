"""Exact top-k by inner product with MaxScore over inverted lists.

Vectors are documents whose terms are the dimensions with a nonzero integer component;
each dimension of a block of vectors has a posting list and the least and greatest value
in it. A query's term has a bound: the most it can add within the block. Sorted by bound,
the terms whose bounds together stay below the query's k-th best score so far are not
essential: a vector in none of the other, essential lists can't enter the result. So the
essential lists are traversed; the vectors that are still competitive with what the other
terms can add are then probed in these, from the largest bound on, and dropped as soon as
what is left can't make them competitive.

A query's first threshold is its k-th best score among `SEEDS` rows that are the same for
all (those with the smallest hashes), so every shard prunes from its first block on. A
shard orders its rows by the seed they resemble most, which keeps the bounds of a block
tight, and visits the blocks by falling bound. The queries of a task are searched together:
the essential lists that most rows are in are one matrix product for all of them.

Rows are dealt to shards of about `shard_rows`, queries to blocks of about `query_rows`;
each pair of a shard and a query block is a task's work of bounded size, and its k best a
query are merged by a ranking of at most k rows for each query and shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors whose postings are built and traversed together; queries searched together.
BLOCK_ROWS = 1024
QUERIES = 256
#: Rows that give the first thresholds, and those of them that rows are ordered by.
SEEDS = 4096
PIVOTS = 32
#: Whole numbers up to this size are exact as doubles.
EXACT = 1 << 53


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v): v has floor(scale * x) of each component. Rows with a null id, vector or component, or a component that is no finite number, are left out."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(usable).select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def _numbers(*arrays: np.ndarray) -> type:
    """Doubles if all inner products are exact in them, which multiplies faster; else 64-bit integers."""
    largest = [float(np.abs(a).max(initial=0)) for a in arrays]
    return np.float64 if np.prod(largest) * arrays[0].shape[1] < EXACT else np.int64


class _Block:
    """Posting lists of some vectors: for each term the rows and values, or the whole column where most rows have it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.low, self.high = np.minimum(x.min(axis=0), 0), np.maximum(x.max(axis=0), 0)
        often = 2 * (x != 0).sum(axis=0) > len(x)
        self.dense = np.flatnonzero(often)
        self.columns = np.ascontiguousarray(x[:, self.dense].T)
        self.lists = [(int(term), rows := np.flatnonzero(x[:, term]), x[rows, term]) for term in np.flatnonzero(~often & x.any(axis=0))]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(q * self.low, q * self.high)


def _merged(k: int, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, in order."""
    order = np.lexsort((ids, -scores, query))
    query = query[order]
    first = np.searchsorted(query, query, side="left")
    order = order[np.arange(len(query)) - first < k]
    return query[np.arange(len(query)) - first < k], ids[order], scores[order]


def _competitive(block: _Block, query_ids: np.ndarray, q: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the pairs whose scores reach the queries' thresholds."""
    width = q.shape[1]
    bounds = block.bounds(q)
    order = np.argsort(bounds, axis=1, kind="stable")  # smallest first
    sums = np.cumsum(np.take_along_axis(bounds, order, axis=1), axis=1)
    rest = (sums < theta[:, None]).sum(axis=1)  # terms whose bounds together are below the threshold
    some = np.flatnonzero(rest < width)
    if not len(some):
        return some, some, some
    q, order, sums, rest, least, own = q[some], order[some], sums[some], rest[some], theta[some], query_ids[some]
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(width)[None, :], axis=1)
    essential = np.where(place >= rest[:, None], q, 0)
    score = essential[:, block.dense] @ block.columns
    for term, rows, values in block.lists:
        asked = np.flatnonzero(essential[:, term])
        if len(asked):
            score[np.ix_(asked, rows)] += essential[asked, term][:, None] * values
    # what the other terms can still add, by how many of them are left
    more = np.concatenate([np.zeros((len(some), 1), sums.dtype), sums], axis=1)
    at, row = np.nonzero((score + more[np.arange(len(some)), rest][:, None] >= least[:, None]) & (own[:, None] != block.ids[None, :]))
    score, left = score[at, row], rest[at]
    done = [(at[left == 0], row[left == 0], score[left == 0])]
    while len(at := at[left > 0]):
        row, score, left = row[left > 0], score[left > 0], left[left > 0] - 1
        term = order[at, left]
        score = score + q[at, term] * block.x[row, term]
        keep = score + more[at, left] >= least[at]
        at, row, score, left = at[keep], row[keep], score[keep], left[keep]
        done.append((at[left == 0], row[left == 0], score[left == 0]))
    at, row, score = (np.concatenate(c) for c in zip(*done))
    return some[at], row, score


def _search(blocks: list[_Block], query_ids: np.ndarray, q: np.ndarray, theta: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best rows that reach its threshold, by falling score and rising id; rows with the query's own id take no part."""
    theta, found = theta.copy(), (np.empty(0, np.int64),) * 2 + (np.empty(0, q.dtype),)
    most = np.array([block.bounds(q).sum(axis=1).max(initial=0) for block in blocks])
    for block in (blocks[i] for i in np.argsort(-most, kind="stable")):
        at, row, score = _competitive(block, query_ids, q, theta)
        if not len(at):
            continue
        found = _merged(k, *(np.concatenate(c) for c in zip(found, (at, block.ids[row], score))))
        query, n = np.unique(found[0], return_counts=True)
        last = np.cumsum(n) - 1
        full = n == k
        theta[query[full]] = np.maximum(theta[query[full]], found[2][last[full]])
    return found


def _lowest(kind: type):
    return -np.inf if kind is np.float64 else -(1 << 62)


def _first_thresholds(seed_ids: np.ndarray, seeds: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among the seeds; the lowest number (-2^62) if there are fewer."""
    out = np.full(len(q), -(1 << 62), np.int64)
    kind = _numbers(q, seeds)
    columns = seeds.T.astype(kind)
    for a in range(0, len(q), QUERIES):
        part = slice(a, a + QUERIES)
        score = q[part].astype(kind) @ columns
        own = query_ids[part][:, None] == seed_ids[None, :]
        score[own] = _lowest(kind)
        if score.shape[1] >= k:
            kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            out[part] = np.where((~own).sum(axis=1) >= k, np.maximum(kth, -float(1 << 62)) if kind is np.float64 else kth, -(1 << 62)).astype(np.int64)
    return out


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones end in zeros."""
    v = table.column("v").combine_chunks()
    size, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy()
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def top_k(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shard_rows: int = 16384, query_rows: int = 4096) -> DataFrame:
    """For each row that is a query (a condition on vec_id): query_id, rank from 1, vec_id, score, of the k rows with the largest integer inner product.

    Ties go to the smaller vec_id. A query's own row is no candidate; so are, should an id repeat, the other rows with it.
    Fewer than k candidates are all returned, with scores of zero or less too. Vectors of different lengths are compared as
    if the shorter ended in zeros. Rows that integer_vectors leaves out take no part. An empty table gives an empty result.
    Scores are 64-bit: components must stay below 2^28 in size. Other columns are ignored.
    """
    vectors = integer_vectors(rows, id_col, vector_col, scale)
    query = vectors.where(is_query)
    n, width, queries = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count(F.when(is_query, 1))).first()
    shards, parts = max(1, -(-n // shard_rows)), max(1, -(-queries // query_rows))
    schema = "query_id bigint, vec_id bigint, score bigint"
    # SEEDS vectors: at most 4096 rows of the vectors' width
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).toArrow()
    seed_ids, seeds = chosen.column("vec_id").to_numpy(), _matrix(chosen, width)

    def first(batches):
        for batch in batches:
            theta = _first_thresholds(seed_ids, seeds, batch.column(0).to_numpy(), _matrix(pa.Table.from_batches([batch]), width), k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(theta)], ["vec_id", "v", "theta"])

    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if shard.num_rows and asked.num_rows:
            ids, x, q = shard.column("vec_id").to_numpy(), _matrix(shard, width), _matrix(asked, width)
            kind = _numbers(q, x)
            likest = (x.astype(np.float64) @ seeds[:PIVOTS].T.astype(np.float64)).argmax(axis=1)
            order = np.lexsort((ids, likest))
            ids, x = ids[order], x[order].astype(kind)
            blocks = [_Block(ids[a : a + BLOCK_ROWS], x[a : a + BLOCK_ROWS]) for a in range(0, len(ids), BLOCK_ROWS)]
            query_ids, theta = asked.column("vec_id").to_numpy(), asked.column("theta").to_numpy()
            theta = np.where(theta == -(1 << 62), _lowest(kind), theta).astype(kind)
            for a in range(0, len(q), QUERIES):
                part = slice(a, a + QUERIES)
                at, found, scores = _search(blocks, query_ids[part], q[part].astype(kind), theta[part], k)
                out.append((query_ids[part][at], found, scores.astype(np.int64)))
        columns = [np.concatenate([np.empty(0, np.int64), *c]) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    # Every row meets every block of queries once, every query every shard once.
    index = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = query.dropDuplicates(["vec_id"]).mapInArrow(first, "vec_id bigint, v array<bigint>, theta bigint")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
    found = index.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
