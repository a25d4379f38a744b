"""Operator 3's blocks are coded in the JVM, byte for byte as range_coder does it."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from routeloom.llm import jvm, range_coder, token_files

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table_of(n):
    return range_coder.ENTRY.pack(7, n, range_coder.HAS_ID | range_coder.FIRST | range_coder.LAST)


def test_blocks_have_the_bytes_of_the_range_coder(spark):
    rng = np.random.default_rng(5)
    blocks = [rng.integers(0, top, size=n) for top, n in ((2, 200), (65536, 2048), (49408, 1), (300, 0), (5, 777))]
    blocks += [np.arange(500) % 3, np.repeat(40000, 400), np.minimum(rng.zipf(1.3, 4000), 65535)]
    rows = [(k, bytearray(table_of(len(b))), bytearray(b.astype("<u4").tobytes())) for k, b in enumerate(blocks)]
    pack = jvm.function(spark, token_files.CODER, "routeloom.BlockCoder$Pack", "binary")
    unpack = jvm.function(spark, token_files.CODER, "routeloom.BlockCoder$Unpack", token_files.PARTS)
    found = spark.createDataFrame(rows, "k int, t binary, i binary").select("k", pack("t", "i").alias("d")).select("k", "d", unpack("d").alias("p"))
    for k, data, parts in found.collect():
        ids = blocks[k].astype("<u4")
        assert bytes(data) == range_coder.pack([(7, len(ids), True, True)], ids, range_coder.encode_blocks([ids])[0])
        assert [tuple(p) for p in parts] == [(0, 0, 7, len(ids), zlib.crc32(ids.tobytes()), True, True)]


def test_ids_without_room_and_damaged_blocks_stop_the_job(spark, tmp_path):
    pack = jvm.function(spark, token_files.CODER, "routeloom.BlockCoder$Pack", "binary")
    with pytest.raises(Exception, match="ids must be below 65536"):
        spark.createDataFrame([(bytearray(table_of(1)), bytearray(np.array([70000], "<u4").tobytes()))], "t binary, i binary").select(pack("t", "i")).collect()
    docs = spark.createDataFrame([(1, "some words"), (2, "and others")], "doc_id bigint, text string")
    whole, damaged = str(tmp_path / "whole"), str(tmp_path / "damaged")
    token_files.write(docs, whole, WORD_TOKENIZER)
    last = F.expr("substr(data, length(data))")
    other = F.when(last == F.lit(b"\x00"), F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
    spark.read.parquet(whole).withColumn("data", F.concat(F.expr("substr(data, 1, length(data) - 1)"), other)).write.parquet(damaged)
    assert token_files.read(spark, whole).count() == 2
    with pytest.raises(Exception, match="a block is damaged"):
        token_files.read(spark, damaged)


def test_a_block_is_coded_once_and_outside_python(spark, tmp_path):
    """Of the query that reads, only the joining of split documents is a Python worker's."""
    docs = spark.createDataFrame([(1, "some words"), (2, "and others")], "doc_id bigint, text string")
    token_files.write(docs, str(tmp_path / "files"), WORD_TOKENIZER)
    unpack = jvm.function(spark, token_files.CODER, "routeloom.BlockCoder$Unpack", token_files.PARTS)
    plan = spark.read.parquet(str(tmp_path / "files")).select(unpack("data").alias("p")).selectExpr("inline(p)")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("UDF(") == 1 and "Python" not in plan and "InArrow" not in plan


def test_words_of_a_piece_are_looked_up_once_and_mixed_ones_by_their_stretches(monkeypatch):
    from tokenizers import Tokenizer

    from routeloom.llm.word_tokens import WordEncoder

    encoder, library = WordEncoder(WORD_TOKENIZER), Tokenizer.from_file(WORD_TOKENIZER)
    texts = ["", "  ", " a  b\x0b\x0cc\r\n ", "don't DON'T 'tis 'S a!'s ''ll x'LLy 12,5% (a) 1'2're", "<|endoftext|> a<|startoftext|>b <|x|> \x1cq\x1f \x7f", "ﬁ İ ſ KK été-é"]
    asked, alone, ids_of, each = [], [], encoder._ids_of, encoder._each
    monkeypatch.setattr(encoder, "_ids_of", lambda words: asked.extend(words) or ids_of(words))
    monkeypatch.setattr(encoder, "_each", lambda words: alone.extend(words) or each(words))
    for got, text in zip(encoder.encode([t.encode() for t in texts + texts]), texts + texts):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) and b"don't" in asked
    assert "don't" not in alone and "<|endoftext|>" in alone
