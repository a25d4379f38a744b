"""Near copies against brute force over all pairs."""

import random

import corpus_pipeline
from routeloom.llm import near_copies, simhash


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def roots(texts):
    sets = [shingles(t or "") for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_against_all_pairs(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 300))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    texts += [" ".join(changed(rng, b, max(1, len(b) // 60))) for b in base]
    long = [f"v{rng.randrange(3000)}" for _ in range(200)]
    texts += [" ".join(changed(rng, long, rng.randrange(1, 6))) for _ in range(90)]  # a group of which not all pairs are near enough
    texts += [texts[0].upper(), texts[1].replace(" ", "\n"), None, "", " ", "a b", "A b", "a c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = roots(texts)
    assert sum(i != r for i, r in enumerate(want)) > 100
    for most in (8192, 40):
        got = {r.doc_id: r.component_id for r in near_copies.near_copies(df, bucket_rows=most).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert near_copies.near_copies(df.where("doc_id < 0")).count() == 0


def test_stage_drops_copies_of_more_than_four_bits(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(3000)}" for _ in range(120)] for _ in range(20)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:60] + ["other", "words"] + b[60:]) for b in base]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert simhash.near_duplicates(df).where("doc_id <> component_id").count() < 20
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, df, "").collect()) == list(range(20))


def test_segments_meet_under_deletion_variants(spark):
    """Two segments of a fingerprint that differ in a bit are compared, whatever the bit; those that differ in two are not."""
    import numpy as np
    import pyarrow as pa

    segment, rng = 2 * near_copies.HALF, np.random.default_rng(3)
    base = rng.integers(0, 2, 1280).astype(np.uint8)

    def met(flips, shift, most=100):
        """Whether a fingerprint meets base in its second segment; the others differ in two bits each."""
        other = base.copy()
        for s in range(near_copies.SEGMENTS):
            other[[s * segment + bit for bit in (flips if s == 1 else [3, 14])]] ^= 1
        fps = [np.packbits(x).view(np.int64) for x in (base, other)]
        dealt = list(near_copies._dealt([pa.record_batch([pa.array([5, 9]), pa.array(fps, pa.list_(pa.int64()))], ["node", "fp"])]))
        rows = pa.Table.from_batches(dealt if shift else near_copies._variants(dealt)).sort_by("key")
        found = pa.Table.from_batches(near_copies._compare(most, shift)(rows.to_batches(max_chunksize=7)))
        return {(r["a"], r["b"]) for r in found.to_pylist()} == {(9, 5)}

    for shift in (near_copies.HALF, 0):
        assert all(met([bit], shift) for bit in range(segment)) and met([], shift)
        assert not met([2, 3], shift) and not met([9, 10], shift)


def test_pairs_of_blocks_hand_on_few_links_and_are_many_tasks(spark, monkeypatch):
    """The links of a family's pairs of blocks are in proportion to its nodes, not to the pairs; the pairs aren't all one task's."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    rng = random.Random(4)
    long = [f"v{rng.randrange(3000)}" for _ in range(200)]
    texts = [" ".join(changed(rng, long, rng.randrange(1, 5))) for _ in range(90)]
    handed = []

    def counted(links, components=near_copies.components):
        handed.append(links.count())
        return components(links)

    monkeypatch.setattr(near_copies, "components", counted)
    monkeypatch.setattr(near_copies, "BLOCK_NODES", 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r.component_id for r in near_copies.near_copies(df).orderBy("doc_id").collect()] == roots(texts)
    assert 80 < handed[1] <= 3 * 89  # a forest of each of at most three tasks, where 276 pairs of blocks have one each

    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        rows = spark.range(100).select(F.lit(7).cast("bigint").alias("family"), F.col("id").alias("node"))
        dealt = near_copies._dealt_in_pairs(rows, "family", rows.groupBy("family").agg(F.lit(10).alias("blocks")))
        pairs = dealt.groupBy("family", "i", "j").applyInArrow(lambda key, group: pa.table({"n": [group.num_rows]}), "n bigint")
        assert pairs.select(F.spark_partition_id().alias("task")).distinct().count() > 1
        assert pairs.agg(F.count("*"), F.sum("n")).first() == (55, 1000)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
