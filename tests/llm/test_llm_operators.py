"""The corpus operators against brute force, on a fixture with nulls, empty and long texts, ties, repeated rows and other columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from routeloom.llm import bpe, exact_dedup, language_id, maxscore, packing, quality, range_coder, sanitise, simhash, token_counts, token_files
from routeloom.llm.queries import BYTE_RANKS, PIECES, WORD_TOKENIZER

#: Other columns, some with names that operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, h string, key string, h_1 int, `row` string, bucket int, _id int, task int"


def words(rng, n):
    return " ".join(rng.choice(("the", "of", "und", "der", "Haus", "straße", "house", "été", "Niño", "word,", "end.", "x1", "über")) + rng.choice(("", "ing", "en", "s")) for _ in range(n))


def corpus():
    rng = random.Random(7)
    texts = [words(rng, rng.randrange(1, 90)) for _ in range(60)]
    near = words(rng, 300)
    texts += [near, near.replace("the", "thy", 1), near + " more", near.upper()]
    texts += [None, "", " ", "\t\n ", "a", "a b", " a", "a b", "one two three", "ONE two three", "two  spaces", "two spaces", "two\tspaces", "\U0001f600 ok ́x", "x" * 3000, "don't <|endoftext|> stop <|startoftext|>"]
    texts += [words(rng, 4000), "1 " * 2500, texts[0], texts[1], texts[0]]
    rows = [(i, t, None if i % 7 == 0 else ("de" if i % 2 else "en"), None, None, i, None, "k", 1, "r", 2, 3, 4) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5], "en", "s", 1, 1, "", "", 1, "", 1, 1, 1), (None, None, None, None, None, None, None, None, None, None, None, None, None), (10**12, texts[2], *rows[0][2:])]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def text_of(row):
    return row[1] or ""


# ---- SimHash


def plain_fingerprint(text, n=4):
    w = re.split(rb"[\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
    w = [x for x in w if x]
    shingles = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(fps, ids, bits=4):
    n, root = len(fps), list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return [least.get(find(i)) for i in range(n)]


def test_simhash(docs, empty):
    fps = [plain_fingerprint(text_of(r)) for r in ROWS]
    ids = [r[0] for r in ROWS]
    want = sorted(((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, reach(fps, ids))), key=str)
    assert as_rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 6])
def test_simhash_links(spark, bits):
    rng = random.Random(bits)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        for _ in range(4):
            for _ in range(rng.randrange(1, bits + 3)):
                f ^= 1 << rng.randrange(64)
            fps.append(f)
    fps += [fps[0] ^ 1 << b for b in range(40)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    # buckets of more than 16 take the way for large ones
    for most in (8192, 16):
        got = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), bits, bucket_rows=most)).collect()
        root = {r.node: r.root for r in got}
        want = reach(fps, signed, bits)
        assert [root.get(f, f) for f in signed] == want


def test_segments():
    for bits in range(0, 12):
        widths = [w for _, w in simhash.segments(bits)]
        assert sum(widths) == 64 and bits < 2 * len(widths)


# ---- exact duplicates


def test_exact_duplicates(docs, empty):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", text_of(r)) for r in ROWS]
    groups = {}
    for r, t in zip(ROWS, norm):
        groups.setdefault(t, []).append(r[0])
    want = []
    for r, t in zip(ROWS, norm):
        keep = min((i for i in groups[t] if i is not None), default=None)
        want.append((r[0], keep, len(groups[t]), r[0] == keep, hashlib.sha256(t.encode()).hexdigest()))
    few_bits = lambda t: F.shiftrightunsigned(F.xxhash64(t), 61)  # noqa: E731  chains of many different texts
    for options in ({}, {"bucket_bytes": 2000}, {"bucket_bytes": 2000, "key": few_bits}):
        assert as_rows(exact_dedup.duplicates(docs, **options), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=str)
    assert exact_dedup.duplicates(empty).count() == 0


def test_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_LEAST", 20)
    texts = ["hot  text", "hot text", "other", None] * 30 + [f"text {i}" for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r for r in exact_dedup.duplicates(df).collect()}
    assert [(got[i].keep_id, got[i].group_size) for i in range(4)] == [(0, 60), (0, 60), (2, 30), (3, 30)] and sum(r.kept for r in got.values()) == 53 and len(got) == len(texts)


def test_directory_doubles():
    """Against buckets found by splitting key by key: the directory doubles as often as an overfull bucket has all its bits."""
    rng = random.Random(1)
    keys = {rng.getrandbits(64): rng.randrange(1, 100) for _ in range(300)} | {(0xABCDEF << 40) + i: 60 for i in range(40)} | {5: 9000}
    rounds = []

    def histogram(over, depth, bits):
        rounds.append((depth, bits))
        out = {}
        for k, size in keys.items():
            if k >> (64 - depth) in over:
                b, n = out.get(k >> (64 - depth - bits), (0, 0))
                out[k >> (64 - depth - bits)] = (b + size, n + 1)
        return out

    def split(members, start, depth):
        if sum(keys[k] for k in members) <= 500 or len(members) <= 1:
            return [(start, depth)]
        half = start | 1 << (63 - depth)
        return split([k for k in members if k < half], start, depth + 1) + split([k for k in members if k >= half], half, depth + 1)

    d = exact_dedup.Directory.grown(histogram, sum(keys.values()), 500)
    assert list(zip(d.starts.tolist(), d.depths.tolist())) == split(list(keys), 0, 0)
    assert d.depth > 55 and len(rounds) > 3  # keys with 58 bits in common: no bound on the depth
    at = dict(zip(keys, d.bucket(np.array(list(keys), np.uint64).view(np.int64)).tolist()))
    ends = [*d.starts[1:].tolist(), 1 << 64]
    assert all(d.starts[b] <= k < ends[b] for k, b in at.items()) and exact_dedup.Directory.grown(histogram, 0, 500).starts.tolist() == [0]


def test_index_reopened(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    built = exact_dedup.build_index(docs, path, bucket_bytes=2000)
    index = exact_dedup.Index.open(spark, path)
    assert (index.directory.starts == built.directory.starts).all() and index.directory.depth >= 4
    buckets = {r.bucket for r in index.classes.collect()}
    assert len(buckets) > 8
    want = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.duplicates(docs).where("doc_id is not null").collect()}
    got = {r.doc_id: (r.keep_id, r.group_size) for r in index.probe(docs).where("doc_id is not null").collect()}
    assert got == want
    new = spark.createDataFrame([(1, "no such text"), (2, "a\t\nb"), (3, None)], "doc_id bigint, text string")
    assert [(r.doc_id, r.keep_id) for r in index.probe(new).orderBy("doc_id").collect()] == [(1, None), (2, want[69][0]), (3, want[64][0])]


def test_collision_chain():
    import pyarrow as pa

    rows = [(0, 0, 5, b"b", 3, 1), (0, 0, 5, b"a", 9, 2), (0, 0, 5, b"b", 1, 4), (0, 0, 6, b"a", None, 1), (0, 0, 6, b"a", 2, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["owner", "bucket", "key", "text", "least_id", "rows"])
    got = [r for b in exact_dedup._own(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    assert [(r["key"], r["chain"], r["chains"], r["keep_id"], r["group_size"]) for r in got] == [(5, 0, 2, 1, 5), (5, 1, 2, 9, 2), (6, 0, 1, 2, 2)]


# ---- tokens: packing, files, counts, byte-level BPE


def word_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(word_ids, "t"):
        word_ids.t = Tokenizer.from_file(WORD_TOKENIZER)
    return word_ids.t.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, empty):
    for limits in (packing.Limits(), packing.Limits(tokens=64, documents=5, attention=1500, score="dot")):
        size = min(limits.tokens, int((limits.attention or limits.tokens**2) ** 0.5))
        rows = packing.packed(docs, WORD_TOKENIZER, limits=limits).collect()
        want = []
        for r in ROWS:
            ids = word_ids(text_of(r)) + [0]
            want += [(r[0], k // size, k, len(ids[k : k + size]), crc(ids[k : k + size])) for k in range(0, len(ids), size)]
        assert sorted((r[:5] for r in map(tuple, rows)), key=str) == sorted(want, key=str)
        bins = {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sorted(bins) == list(range(len(bins)))
        for items in bins.values():
            items.sort()
            assert [o for o, _ in items] == [sum(n for _, n in items[:k]) for k in range(len(items))]
            assert sum(n for _, n in items) <= limits.tokens and len(items) <= (limits.documents or 10**9) and sum(n * n for _, n in items) <= (limits.attention or 10**18)
        if limits.attention is None:
            total = sum(n for items in bins.values() for _, n in items)
            assert len(bins) <= -(-total // limits.tokens) + 1
    assert packing.packed(empty, WORD_TOKENIZER).count() == 0


def test_plan_is_best_fit():
    """The plan on the histogram gives as many bins as best fit over single items."""
    rng = random.Random(2)
    lengths = [rng.randrange(1, 101) for _ in range(3000)]
    steps = packing.plan({n: lengths.count(n) for n in set(lengths)}, packing.Limits(tokens=100, weights=(1, 0, 0)))
    left = []
    for n in sorted(lengths, reverse=True):
        fit = min((x for x in left if x >= n), default=None)
        if fit is not None:
            left.remove(fit)
        left.append((100 if fit is None else fit) - n)
    used = max(b + k for _, _, b, _, k in steps.tolist())
    assert used == len(left) and packing.plan({}, packing.Limits()).shape == (0, 5)
    with pytest.raises(ValueError):
        packing.plan({200: 1}, packing.Limits(tokens=100))


def test_the_vector_decides():
    """Bin 0 has 224 tokens left and one document, bin 1 has 234 and two: an item of 100 goes to 0 by tokens, to 1 by documents."""
    histogram = {800: 1, 400: 1, 390: 1, 100: 1}
    by_tokens = packing.plan(histogram, packing.Limits(tokens=1024, documents=4, weights=(1, 0, 0)))
    by_vector = packing.plan(histogram, packing.Limits(tokens=1024, documents=4, weights=(0.01, 1, 0.01)))
    assert [int(r[2]) for r in by_tokens if r[0] == 100] == [0] and [int(r[2]) for r in by_vector if r[0] == 100] == [1]
    by_dot = packing.plan(histogram, packing.Limits(tokens=1024, documents=4, weights=(0, 1, 0), score="dot"))
    assert [int(r[2]) for r in by_dot if r[0] == 100] == [0]  # the dot product takes the bin with most left
    rng = random.Random(4)
    lengths = [min(100, int(rng.paretovariate(0.8))) for _ in range(2000)]
    many = {n: lengths.count(n) for n in set(lengths)}
    plans = [packing.plan(many, packing.Limits(tokens=100, weights=w)) for w in ((1, 0, 0), packing.Limits().weights)]
    assert plans[0].tolist() != plans[1].tolist() and packing.bins(plans[0]) == packing.bins(plans[1])


def test_tightest_documents():
    """The capacity binds and costs no bin; half of it would."""
    rng = random.Random(6)
    lengths = [rng.choice((1, 2, 3, 5, 60, 97)) for _ in range(4000)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    free = packing.plan(histogram, packing.Limits(tokens=100, documents=100))
    limits, steps = packing.tightest(histogram, packing.Limits(tokens=100))

    def most(steps):
        held = {}
        for _, _, first, _, n in steps.tolist():
            for b in range(first, first + n):
                held[b] = held.get(b, 0) + 1
        return max(held.values())

    assert packing.bins(steps) == packing.bins(free) and most(steps) <= limits.documents < most(free)
    assert packing.bins(packing.plan(histogram, packing.Limits(tokens=100, documents=limits.documents // 2))) > packing.bins(free)


def test_token_files(spark, docs, empty, tmp_path):
    order = sorted(range(len(ROWS)), key=lambda i: (ROWS[i][0] is not None, ROWS[i][0] or 0))
    for block in (64, 2048):
        path = str(tmp_path / f"files{block}")
        token_files.write(docs, path, WORD_TOKENIZER, block_ids=block)
        got = sorted(map(tuple, token_files.read(spark, path).collect()), key=lambda r: r[1])
        assert sorted((r[0], r[2], r[3]) for r in got if r[0] is not None) == sorted((ROWS[i][0], len(x := word_ids(text_of(ROWS[i])) + [1]), crc(x)) for i in order if ROWS[i][0] is not None)
        assert [r[0] for r in got] == [ROWS[i][0] for i in order]
        assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    token_files.write(empty, str(tmp_path / "none"), WORD_TOKENIZER)
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_damaged_block(spark, docs, tmp_path):
    path = str(tmp_path / "files")
    token_files.write(docs.limit(5), path, WORD_TOKENIZER)
    row = spark.read.parquet(path).orderBy(F.desc("n_ids")).first()
    for at in (0, 5, range_coder.HEADER.size + 1, len(row.data) - 1):
        data = bytearray(row.data)
        data[at] ^= 1
        with pytest.raises(ValueError):
            token_files.range_coder.unpack(bytes(data))
    with pytest.raises(ValueError):
        range_coder.unpack(row.data[:10])


def test_range_coder_round_trip():
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, top, size=n) for top, n in ((2, 200), (65536, 300), (49408, 1), (300, 0), (5, 777), (1, 9))] + [np.arange(500) % 3, np.repeat(40000, 400)]
    coded = range_coder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode_blocks(coded, list(map(len, blocks)))))
    assert sum(map(len, coded[-1])) < 60  # what repeats takes next to no room
    alone = [range_coder.encode_blocks([b])[0] for b in blocks]
    assert alone == coded  # each block is coded on its own
    with pytest.raises(ValueError):
        range_coder.encode_blocks([np.array([70000])])


def test_crc_of_parts():
    a, b = b"some bytes", b"and others, more of them"
    assert token_files.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def byte_encoding():
    return token_counts.encoding(BYTE_RANKS, public_tokenizers.PATTERN)


def test_byte_bpe(docs, empty):
    want = []
    for r in ROWS:
        ids = byte_encoding().encode_ordinary(text_of(r))
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text_of(r).encode()).hexdigest()))
    assert as_rows(bpe.round_trip(docs, BYTE_RANKS, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert bpe.round_trip(empty, BYTE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_texts(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(" ab\n'.sé你\t1Z") for _ in range(rng.randrange(80))) for _ in range(800)]
    codec = bpe.Codec(BYTE_RANKS, public_tokenizers.PATTERN)
    got = codec.encode(texts)
    assert got == [" ".join(map(str, byte_encoding().encode_ordinary(t))) for t in texts]
    assert codec.decode([bpe._numbers(g) for g in got]) == [t.encode() for t in texts]
    monkeypatch.setattr(bpe, "QUERY_ROWS", 2000)  # queries that stop early go on
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    small, long = bpe.Codec(BYTE_RANKS, public_tokenizers.PATTERN), "".join(rng.choice("abcdefgh") for _ in range(700))
    assert small.encode([long, "a " + long[:50]]) == [" ".join(map(str, byte_encoding().encode_ordinary(t))) for t in (long, "a " + long[:50])]
    assert [small.encode([t])[0] for t in texts[:50]] == got[:50]
    monkeypatch.setattr(bpe, "PIECE_CHARS", 10)
    assert all("".join(bpe._parts(t)) == t for t in texts)


def test_byte_bpe_long_words():
    """Words without a break, of up to 200,000 letters; overlapping and repeated pairs; every long word also by the query for short ones."""
    rng = random.Random(8)
    glued = lambda n: "".join(rng.choice(("the", "house", "and", "relation", "ship", "national", "ing", "z", "über")) for _ in range(n))
    codec = bpe.Codec(BYTE_RANKS, public_tokenizers.PATTERN)
    words = ["=" * 5000, "a" * 4999, "ab" * 700, "aab" * 500, "straße" * 1000, glued(2000), "".join(rng.choice("abcdefgh") for _ in range(5000)), "你好" * 400]
    words += ["".join(rng.choice("aab") for _ in range(n)) for n in range(60, 120)]
    got = codec.encode_words([w.encode() for w in words])
    assert [g.tolist() for g in got] == [byte_encoding().encode_ordinary(w) for w in words]
    long = glued(48000)
    assert len(long) > 200_000
    ids = codec.encode([long])[0]
    assert codec.decode([bpe._numbers(ids)]) == [long.encode()]
    half = long[:20000]
    assert codec.encode([half])[0] == " ".join(map(str, byte_encoding().encode_ordinary(half)))


def test_token_counts(docs, empty):
    n = [len(byte_encoding().encode_ordinary(text_of(r))) for r in ROWS]
    totals = token_counts.token_counts(docs, BYTE_RANKS, public_tokenizers.PATTERN).cache()
    rows = {r.n_tokens: r for r in totals.collect()}
    assert set(rows) == set(n)
    for limit, r in rows.items():
        within = [x for x in n if x <= limit]
        assert (r.n_docs, r.docs_within, r.docs_longer, r.tokens_within) == (n.count(limit), len(within), len(n) - len(within), sum(within))
        assert r.tokens_truncated == sum(min(x, limit) for x in n) and r.tokens_lost == sum(n) - r.tokens_truncated and r.docs_total == len(n) and r.tokens_total == sum(n)
    for limit in (0, 1, 7, 100, 10**6):
        assert token_counts.truncated_total(totals, limit) == sum(min(x, limit) for x in n)
    for share in (0.1, 0.5, 1.0):
        assert token_counts.quantile_length(totals, share) == sorted(n)[max(0, -(-int(share * 1000) * len(n) // 1000) - 1)]
    assert token_counts.token_counts(empty, BYTE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_count_blocks(spark):
    hist = spark.createDataFrame([(n, n % 3 + 1) for n in range(0, 20000, 37)], "n_tokens bigint, n_docs bigint")
    for r in token_counts.limit_totals(hist).where("n_tokens % 100 = 0").collect():
        assert r.tokens_truncated == sum((n % 3 + 1) * min(n, r.n_tokens) for n in range(0, 20000, 37))


# ---- search


def test_maxscore(spark):
    rng = np.random.default_rng(4)
    vectors = [list(map(float, rng.normal(0, 0.2, 12))) for _ in range(300)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(300, vectors[0]), (301, vectors[0]), (302, None), (303, [1.0, None] + [0.0] * 10), (304, [float("nan")] * 12), (305, [float("inf")] * 12), (None, vectors[1]), (306, [0.5, 0.5]), (320, [0.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("shard", F.lit(1)).withColumn("score", F.lit("x"))
    stored = {r.vec_id: [int(np.floor(64 * x)) for x in r.embedding] for r in df.collect() if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)}
    want = []
    for q in stored:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(stored[q], v)), i) for i, v in stored.items() if i != q)[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    for options in ({}, {"shard_rows": 50, "query_rows": 5}):
        assert as_rows(maxscore.top_k(df, F.col("vec_id") % 20 == 0, **options), "query_id", "rank", "vec_id", "score") == sorted(want, key=str)
    few = df.where("vec_id in (0, 5, 20)")
    assert maxscore.top_k(few, F.col("vec_id") % 20 == 0).count() == 4
    assert maxscore.top_k(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_maxscore_skips():
    """Vectors in no essential list are never scored, and the result is the same."""
    rng = np.random.default_rng(5)
    x = np.where(rng.random((6000, 30)) < 0.1, rng.integers(1, 50, (6000, 30)), 0)
    ids = np.arange(6000)
    blocks = [maxscore._Block(ids[a : a + 2048], x[a : a + 2048]) for a in range(0, 6000, 2048)]
    for q in x[:40]:
        _, got, scores = maxscore._search(blocks, np.array([-1]), q[None, :], np.array([-(1 << 62)]), 10)
        full = x @ q
        want = np.lexsort((ids, -full))[:10]
        assert (got == want).all() and (scores == full[want]).all()


# ---- language and quality


def test_language(spark, docs, empty):
    rng = random.Random(3)
    de, en = ("der", "und", "straße", "nicht", "über", "haus", "schön"), ("the", "and", "house", "with", "not", "over", "nice")
    rows = [(i, " ".join(rng.choice(de if i % 2 else en) for _ in range(30)), "de" if i % 2 else "en") for i in range(60)] + [(60, None, "de"), (61, "x", None)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), PIECES)
    assert model.languages == ("de", "en")
    tests = [("Das Haus und die Straße", "de"), ("The house, and the street.", "en"), ("", "und"), (None, "und"), ("12 + 3 !", "und"), ("straße" * 800, "de")]
    tests += [(t, "und") for t in ("½ 12", "x² ①"[1:], "Ⅳ ⅷ", "_ 3_4", "٣٤", "́")] + [("½haus", "de")]  # number signs, digits of any script and marks are no letters
    df = spark.createDataFrame([(i, t, "zz") for i, (t, _) in enumerate(tests)], "doc_id bigint, text string, lang_pred string")
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert [got[i].lang_pred for i in range(len(tests))] == [w for _, w in tests] and all(0 <= r.score <= 1 for r in got.values())
    assert as_rows(language_id.recognised(df, model), "doc_id", "lang_pred") == [(0, "zz"), (1, "zz"), (12, "zz"), (5, "zz")]
    assert language_id.predict(docs, model).count() == len(ROWS) and language_id.predict(empty, model).count() == 0
    none = language_id.train(spark.createDataFrame([], "doc_id bigint, text string, lang string"), PIECES)
    assert {r.lang_pred for r in language_id.predict(df, none).collect()} == {"und"}


def cuts(v, word):
    """Every way to cut a word into pieces, as ids."""
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        i = v.ids.get(word[:n]) or (v.rare if n == 1 else 0)
        if i:
            for rest in cuts(v, word[n:]):
                yield (i, *rest)


def test_all_segmentations_count():
    """Forward and backward passes equal the sums over every way to cut a word, written out."""
    v = language_id.Vocabulary.of(PIECES)
    assert {"▁international", "▁relationship"} <= set(v.ids)  # long pieces too
    rng = np.random.default_rng(1)
    p = rng.random((v.size, 2)) / 50
    p[0], p[-1] = 0, language_id.RARE
    model = language_id.Model(PIECES, ("a", "b"), p, np.zeros(2))
    words = ["a", "the", "straße", "information", "international", "ñandú", "一b"]
    totals = [[sum(np.prod(p[list(c), k]) for c in cuts(v, "▁" + w)) for k in (0, 1)] for w in words]
    assert np.allclose(model.words(words), np.log(totals))
    for w, total in zip(words, totals):
        want = np.zeros(v.size)
        for c in cuts(v, "▁" + w):
            np.add.at(want, list(c), 3 * np.prod(p[list(c), 0]) / total[0])
        assert np.allclose(language_id._expected(v.lattice([w, "x"], 32), p[:, 0], np.array([len(w) + 1, 2]), np.array([3.0, 0.0])), want)
    long = language_id._expected(v.lattice(["straße" * 300], 2048), p[:, 0] / 1e3, np.array([1801]), np.array([1.0]))
    assert np.isclose((long * v.lengths).sum(), 1801)  # each cut has as many characters as the word


def test_language_learns_from_all_words(spark):
    """Rare and long words of the sample count: the model equals one learned here from the same words."""
    long = "donaudampfschifffahrtselektrizitätenhauptbetriebswerkbauunterbeamtengesellschaft"
    rows = [(i, f"wort{chr(97 + i % 26)} {long} und ½ {i}", "de") for i in range(30)] + [(i, "the house", "en") for i in range(30, 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got, v = language_id.train(df, PIECES, rounds=2), language_id.Vocabulary.of(PIECES)
    counts = {}
    for _, t, g in rows:
        for w in re.findall(r"[^\W\d_½]+", t.lower()):
            counts.setdefault(g, {}).setdefault(w, []).append(1)
    assert got.languages == ("de", "en")
    for k, g in enumerate(got.languages):
        now = np.full(v.size, 1 / v.size)
        for _ in range(2):
            now[0], now[-1] = 0, language_id.RARE
            expected = np.full(v.size, 0.05)
            for w, n in counts[g].items():
                expected += language_id._expected(v.lattice([w], len(w) + 1), now, np.array([len(w) + 1]), np.array([float(len(n))]))
            expected[0] = expected[-1] = 0
            now = expected / expected.sum()
        assert np.allclose(got.p[1:-1, k], now[1:-1])


def test_quality(spark, docs, empty):
    rng = random.Random(9)
    good = lambda: " ".join(words(rng, 40).split())
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, ("SPAM!! " * 40 if i % 8 == 0 else good().replace(" ", "### ")) if bad else good()))
        labels.append((i, int(not bad)))
    labels += [(None, 1), (3, None), (10**6, 1)]
    d, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = quality.train(d, lab)
    got = {r.doc_id: r for r in quality.scored(d, model).collect()}
    assert np.mean([got[i].predicted == int(i % 4 != 0) for i in range(400)]) > 0.98
    # the column expression is the model
    x = np.array([list(r)[1:] for r in quality.with_statistics(d, "text").orderBy("doc_id").select("doc_id", *(f"_{s}" for s in quality.STATISTICS)).collect()], float)
    assert np.allclose([got[i].score for i in range(400)], 1 / (1 + np.exp(-model.margin(x)))) and 0 < len(model.rules) < 60
    scores = quality.scored(docs, model)
    assert scores.count() == len(ROWS) and scores.where("score is null or score < 0 or score > 1").count() == 0 and quality.scored(empty, model).count() == 0
    assert quality.train(d, lab.limit(0)).rules == ()


# ---- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d) if kind == "card" else 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_sanitise_base(spark, docs, empty):
    rng = random.Random(11)
    pieces = ["a.b@c.de", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (068) 555-2748", "+49.30", " ", "-", "é\U0001f600", "5500005555555559", "7", "99999999999999999999", "%", "a@b@c.d", "_d@e.f-g.h", "001.002.003.004", "1.2.3.4.5.6.7.8"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(600)] + ["1 2 " * 9000, "a" * 40000, "9" * 30000, "a.a" * 9000, "x@" + "a." * 8000 + "b", "+1" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in sanitise.digests(sanitise.spans(df, limits=sanitise.Thresholds(least_texts=10**6))).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t)
        assert got[i].spans == want and got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t[:200]
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(len(re.findall(k + ":", want)) for k in BASE)
    assert sanitise.digests(sanitise.spans(docs)).count() == len(ROWS) and sanitise.digests(sanitise.spans(empty)).count() == 0


def test_sanitise_terms(spark):
    rows = [(i, f"note {i} ask Quillon Marsh at marsh@corp.example soon, number {i}") for i in range(6)] + [(10 + i, f"the note and ask the others quite soon, a number {i}") for i in range(60)] + [(90, None), (91, "Quillon alone")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"h": F.lit("x"), "_m": F.lit(1), "n_chars": F.lit(5)})
    found = {r.doc_id: r for r in sanitise.spans(df, limits=sanitise.Thresholds(least_texts=3)).collect()}
    terms = {rows[0][1][s.start : s.end]: s.value for s in found[0].added}
    assert terms["Marsh"] == "remove" and terms["Quillon"] == "generalise" and "ask" not in terms and "soon" not in terms
    assert found[91].added == [] and found[91].base == []
    clean = {r.doc_id: r.text for r in sanitise.sanitised(df, limits=sanitise.Thresholds(least_texts=3)).collect()}
    assert clean[0] == "note 0 ask qui*  at [EMAIL] soon, number 0" and clean[91] == "Quillon alone" and clean[90] is None and len(clean) == len(rows)


def test_batches_of_texts_are_bounded(spark):
    """Batches for Python workers are cut by bytes, not only by rows."""
    import pyarrow as pa

    from routeloom.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    docs = spark.range(3000, numPartitions=1).selectExpr("id as doc_id", "repeat('word ', 2000) as text")
    found = [r.n for r in common.keyed_texts(docs).mapInArrow(sizes, "n bigint").collect()]
    assert len(found) > 5 and max(found) < 2 * common.BATCH_BYTES


def test_word_ids_through_generations_of_the_cache(monkeypatch):
    """The library's ids also when a text has more new words than the cache has room for."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from routeloom.llm import word_tokens

    texts = ["Anly anly, ANLY. anly é. É straße, 12, x. . ,", "anly. thonre, Thonre", "a\n\nb  c  d", "other words, here.", "thonre anly here"]
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(word_tokens, "CACHE_ENTRIES", 5)
    encoder, library = word_tokens.WordEncoder(path), Tokenizer.from_file(path)
    for text in texts * 2:
        assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_byte_words_are_encoded_once_with_and_without_a_mark(monkeypatch):
    import public_tokenizers

    from routeloom.llm import bpe

    texts = ["Anly anly, ANLY. anly é. É straße, 12, x. . ,", "anly. thonre, Thonre", "a\n\nb  c  d", "other words, here.", "thonre anly here"]
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    asked, of_words = [], codec.encode_words
    monkeypatch.setattr(codec, "encode_words", lambda words: asked.extend(words) or of_words(words))
    for text in texts:
        assert codec.encode([text]) == [" ".join(str(i) for w in codec.find(text) for i in of_words([w.encode()])[0].tolist())]
    assert asked.count(b" anly") == asked.count(b" here") == 1
