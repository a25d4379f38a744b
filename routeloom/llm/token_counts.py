"""Token counts from one exact histogram of encoded lengths.

Every question about lengths under a context limit is a suffix or prefix sum of the
histogram: documents longer than the limit, tokens kept when texts are cut there, the
share lost, and quantiles. The histogram is combined before its shuffle; the sums run
over blocks of lengths, with one row a block for what lies beyond, so that no task takes
more than one block of lengths and the driver takes none.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_worker, keyed_texts

#: Lengths of one block of the sums.
BLOCK = 4096

_encodings: dict[str, object] = {}


def encoding(path: str, pattern: str):
    """The tiktoken encoding of a file of ranks, kept for the Python worker's life."""
    import tiktoken

    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def lengths(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for each row; 0 for null and empty texts."""

    def run(batches):
        encode = encoding(ranks_path, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(in_worker(run), "doc_id bigint, n_tokens bigint")


def histogram(counted: DataFrame) -> DataFrame:
    """(n_tokens, n_docs), exact."""
    return counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limit_totals(hist: DataFrame) -> DataFrame:
    """One row for each length L that occurs, as a context limit:

    n_docs of that length; docs_longer; docs_within (shorter or as long); tokens_within (of those); tokens_truncated (of
    all documents, cut at L); tokens_lost; docs_total, tokens_total; quantile (the share of documents within L).
    Between two lengths that occur, tokens_truncated grows by docs_longer a token, so the rows answer every limit.
    """
    hist = cut(hist.withColumn("block", F.expr(f"n_tokens div {BLOCK}")))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    # one row for each block: the windows over them are small
    blocks = blocks.selectExpr(
        "block as b", "sum(d) over (order by block rows unbounded preceding) - d as docs_before", "sum(t) over (order by block rows unbounded preceding) - t as tokens_before",
        "sum(d) over () as docs_total", "sum(t) over () as tokens_total",
    )
    within = "over (partition by block order by n_tokens rows unbounded preceding)"
    out = hist.join(blocks, F.col("block") == F.col("b")).selectExpr(
        "n_tokens", "n_docs", f"docs_before + sum(n_docs) {within} as docs_within", f"tokens_before + sum(n_docs * n_tokens) {within} as tokens_within", "docs_total", "tokens_total"
    )
    return out.selectExpr(
        "n_tokens", "n_docs", "docs_within", "docs_total - docs_within as docs_longer", "tokens_within",
        "tokens_within + (docs_total - docs_within) * n_tokens as tokens_truncated",
        "tokens_total - tokens_within - (docs_total - docs_within) * n_tokens as tokens_lost",
        "docs_total", "tokens_total", "docs_within / docs_total as quantile",
    )


def truncated_total(totals: DataFrame, limit: int) -> int:
    """Tokens of all documents when each is cut at any limit, from the rows of limit_totals."""
    row = totals.where(F.col("n_tokens") <= limit).orderBy(F.desc("n_tokens")).select("n_tokens", "tokens_truncated", "docs_longer").first()
    if row is None:  # every document is longer than the limit
        row = totals.agg(F.lit(0), F.lit(0), F.coalesce(F.max("docs_total"), F.lit(0))).first()
    return row[1] + row[2] * (limit - row[0])


def quantile_length(totals: DataFrame, share: float) -> int | None:
    """The smallest length within which at least this share of the documents is; null for an empty table."""
    row = totals.where(F.col("docs_within") >= F.lit(share) * F.col("docs_total")).agg(F.min("n_tokens")).first()
    return row[0]


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of limit_totals for a table of documents.

    Null and empty texts have no tokens and count as documents of length 0. Repeated rows count each. Ids and other
    columns do not matter. An empty table gives no rows.
    """
    return limit_totals(histogram(lengths(docs, ranks_path, pattern, id_col, text_col)))
