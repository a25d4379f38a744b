"""Vector best-fit packing of token sequences.

Items have a vector of needs: tokens, one document, and attention cost (the square of the
length). A bin has a capacity in each dimension. Items are taken by falling length; among
the bins where the item fits under every constraint, the one that scores best takes it:
either the largest weighted dot product of needs and residuals, or the smallest weighted
norm of what would be left. If none fits, a new bin opens.

An item's vector depends on its length only, and bins with equal contents are
interchangeable. So the packing is planned on the histogram of lengths, of at most
`capacity` entries whatever the input is: a step places as many items of one length as
there are equal bins, and the plan says for each length which ranks go to which bins. The
items (rows of a few numbers, without texts or ids) are then dealt to ranges of lengths,
and within a length of hashes, so that a frequent length is many tasks' work. Each task
numbers its items of a length from the number that the ranges before it hold; there are at
most as many such numbers as lengths and tasks together, and those are broadcast. Neither
the items nor the bins are ever in one place.

`tightest` gives the least capacity of documents, of some powers of two, at which the plan
needs no more bins than without one, so that it binds and costs nothing.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_worker, keyed_texts, parallelism, stored
from .word_tokens import WordEncoder, encoded


@dataclass(frozen=True)
class Limits:
    """Capacities of a bin and the weights of the score.

    Without a capacity of its own, a bin has as many documents as tokens and an attention cost of the square of the tokens,
    which no content exceeds: they do not bind, but what is left of them counts in the choice of a bin.
    """

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.5, 0.5)
    score: str = "norm"

    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


def plan(histogram: dict[int, int], limits: Limits) -> np.ndarray:
    """Rows (length, first rank, first bin, offset, items), sorted by length and rank: ranks r .. r + items - 1 go to bins b .. in turn.

    Groups of equal bins are arrays, so a step costs one look at all groups. A length makes at most two new groups,
    so there are at most two for each length of the histogram, and the plan has at most as many rows a length.
    """
    capacity = limits.capacity()
    if any(length > capacity[0] or length * length > capacity[2] or length < 1 for length in histogram):
        raise ValueError("an item is larger than a bin")
    weights = np.array(limits.weights) / capacity.astype(float) ** (1 if limits.score == "dot" else 2)
    # what is left in the bins of each group, the first bin's number, and the number of bins
    left, first, count = np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    rows, bins = [], 0
    for length in sorted(histogram, reverse=True):
        need, items, rank = np.array([length, 1, length * length]), histogram[length], 0
        while items:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if len(fits):
                after = left[fits] - need
                score = (left[fits] * need / capacity) @ weights if limits.score == "dot" else -((after.astype(float) ** 2) @ weights)
                g = fits[np.argmax(score)]
                n = min(items, int(count[g]))
                rows.append((length, rank, first[g], capacity[0] - left[g, 0], n))
                taken, start = left[g] - need, first[g]
                if n < count[g]:
                    first[g] += n
                    count[g] -= n
                else:
                    keep = np.arange(len(count)) != g
                    left, first, count = left[keep], first[keep], count[keep]
            else:
                # new bins: each takes as many of these items as fit, while there are items for whole bins
                per = max(1, min(int((capacity // need).min()), items))
                n = items // per
                for k in range(per):
                    rows.append((length, rank + k * n, bins, k * length, n))
                taken, start, n_items = capacity - per * need, bins, n * per
                bins += n
                items -= n_items
                rank += n_items
                left, first, count = np.vstack([left, taken]), np.append(first, start), np.append(count, n)
                continue
            items -= n
            rank += n
            left, first, count = np.vstack([left, taken]), np.append(first, start), np.append(count, n)
        useful = left[:, 0] > 0
        left, first, count = left[useful], first[useful], count[useful]
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


#: Capacities of documents that `tightest` tries.
DOCUMENTS = tuple(1 << k for k in range(1, 11))


def bins(steps: np.ndarray) -> int:
    return int((steps[:, 2] + steps[:, 4]).max(initial=0))


def tightest(histogram: dict[int, int], limits: Limits) -> tuple[Limits, np.ndarray]:
    """limits with the least capacity of documents that costs no bin, found by halving, and the plan. A capacity that is set stays."""
    steps = plan(histogram, limits)
    if limits.documents:
        return limits, steps
    least, low, high = bins(steps), 0, len(DOCUMENTS)
    while low < high:
        middle = (low + high) // 2
        tried = replace(limits, documents=DOCUMENTS[middle])
        found = plan(histogram, tried)
        if bins(found) <= least:
            limits, steps, high = tried, found, middle
        else:
            low = middle + 1
    return limits, steps


def _pieces(path: str, end_id: int, size: int):
    """The pieces of each document."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        encoder = WordEncoder.of(path)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            ids_of, out = batch.column(0).to_pylist(), []
            for row, ids in encoded(batch, encoder):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    out.append((ids_of[row], piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def _numbered(batches):
    """Adds the task and the rank among the task's pieces of the same length; these come sorted by length."""
    task, last, n = TaskContext.get().partitionId(), -1, 0
    for batch in batches:
        length = batch.column("length").to_numpy()
        if not len(length):
            continue
        rows = np.arange(len(length))
        first = np.flatnonzero(np.append(True, length[1:] != length[:-1]))
        rank = rows - np.repeat(first, np.diff(np.append(first, len(rows))))
        rank[length == last] += n
        last = length[-1]
        n = rank[-1] + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(rows), task)), pa.array(rank)], [*batch.schema.names, "task", "in_task"])


def _place(steps: np.ndarray):
    """Adds sequence_id and offset to (length, rank)."""
    base = steps[:, 0] << 40 | steps[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            step = np.searchsorted(base, length << 40 | rank, side="right") - 1
            sequence = steps[step, 2] + rank - steps[step, 1]
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(steps[step, 3])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, limits: Limits = Limits()) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone, a piece of one token. Only documents longer than a sequence are cut, into whole
    sequences and a rest. Rows with a null id and repeated rows are packed like any other. An empty table gives an empty
    result. Other columns are ignored. Sequences are numbered from 0 without gaps; each is filled from offset 0 on.
    Without a capacity of documents in limits, `tightest` sets one.
    """
    spark, size = docs.sparkSession, limits.tokens
    if limits.attention:  # a piece must fit alone
        size = min(size, int(limits.attention**0.5))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = stored(keyed_texts(docs, id_col, text_col).mapInArrow(in_worker(_pieces(tokenizer_path, end_id, size), WordEncoder), schema), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # at most one row for each length
    steps = tightest(histogram, limits)[1]
    dealt = pieces.repartitionByRange(parallelism(spark), "length", F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions("length")
    ranked = stored(dealt.mapInArrow(_numbered, schema + ", task bigint, in_task bigint"), "ranked-pieces")
    by_task = ranked.groupBy("length", "task").agg(F.count("*").alias("n"))
    # ranges: a task shares no more than its first and last length with others
    before = by_task.selectExpr("length", "task", "sum(n) over (partition by length order by task rows unbounded preceding) - n as before")
    placed = ranked.join(F.broadcast(before), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("in_task")).alias("rank"))
    return placed.mapInArrow(_place(steps), schema + ", sequence_id bigint, offset bigint")
