"""The pipeline against a plain version, on a small corpus."""

import re

import public_tokenizers  # noqa: F401
from test_llm_operators import plain_spans, word_ids, words
from test_near_copies import roots

import corpus_pipeline


def small(path, spark):
    import random

    rng = random.Random(21)
    texts = [words(rng, 60) for _ in range(40)]
    texts += [texts[0], "  ".join(texts[1].split(" ")), texts[2] + " end", None, "", "12 34", texts[3].replace(" ", " mail me@corp.example ", 1), "call +1 (068) 555-2748 or 10.0.0.1 " + texts[4]]
    rows = [(i, t, "de" if i % 2 else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    return texts


def plain(texts):
    kept = [(i, t) for i, t in enumerate(texts) if t and re.search(r"[a-zéñöüß]", t.lower())]
    seen, unique = set(), []
    for i, t in kept:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        if n not in seen:
            seen.add(n)
            unique.append((i, t))
    left = [row for k, (row, r) in enumerate(zip(unique, roots([t for _, t in unique]))) if k == r]
    out = {}
    for i, t in left:
        spans = [s.split(":") for s in plain_spans(t).split(",") if s]
        for kind, a, b in sorted(spans, key=lambda s: -int(s[1])):
            t = t[: int(a)] + f"[{kind.upper()}]" + t[int(b) :]
        out[i] = len(word_ids(t)) + 1
    return out


def test_pipeline(spark, tmp_path):
    texts = small(str(tmp_path), spark)
    want = plain(texts)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    assert len({r.sequence_id for r in rows}) == -(-sum(want.values()) // 2048) and [n for n, _ in corpus_pipeline.STAGES][0] == "language_id"


def test_stages_keep_columns(spark, tmp_path):
    small(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= docs.count(), name


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, `row` string, _id int, _h int, h string, stays string, key string, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", 1, 2, "h", "no", "k", 0.5) for i, t in rows], COLUMNS)


def left(stage, df):
    out = stage(df.sparkSession, df, "")
    assert out.columns == df.columns
    found = out.collect()
    assert all((r["row"], r._id, r._h, r.h, r.stays, r.key, r.score) == ("r", 1, 2, "h", "no", "k", 0.5) for r in found)
    return sorted(((r.doc_id, r.text) for r in found), key=str)


def test_an_id_with_two_texts(spark):
    """Only the copy goes, not another text with the same id."""
    import random

    a, b = (words(random.Random(k), 60) for k in (1, 2))
    assert left(corpus_pipeline.exact, table(spark, [(3, a), (5, a.replace(" ", "  ")), (5, b)])) == sorted([(3, a), (5, b)], key=str)
    assert left(corpus_pipeline.near, table(spark, [(3, a), (5, a + " end"), (5, b)])) == sorted([(3, a), (5, b)], key=str)
    # two near texts with the smallest id: one stays
    assert len(left(corpus_pipeline.near, table(spark, [(3, a), (3, a + " end"), (7, a + " more")]))) == 1


def test_nulls_and_repeated_rows(spark):
    import random

    a, b = (words(random.Random(k), 60) for k in (3, 4))
    rows = [(1, a), (1, a), (None, a), (None, b), (None, b), (2, None), (2, ""), (None, None), (9, "x" * 40000 + " " + words(random.Random(5), 60))]
    want = sorted([(1, a), (None, b), rows[-1]], key=str)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        got = left(stage, table(spark, rows))
        assert [r for r in got if r[1]] == want and len([r for r in got if not r[1]]) == 1
    rows += [(4, "mail me@corp.example now"), (None, "mail me@corp.example now")]
    clean = [t for _, t in left(corpus_pipeline.private, table(spark, rows))]  # in so small a table the words beside the address disclose it
    assert len(clean) == len(rows) and sum("[EMAIL]" in (t or "") for t in clean) == 2 and not any("corp" in (t or "") for t in clean) and clean.count(None) == 2
    assert len(left(corpus_pipeline.language, table(spark, rows))) == 8
    assert corpus_pipeline.packed(spark, table(spark, rows), "").where("doc_id is null").count() >= 5


def test_empty_tables(spark):
    empty = table(spark, [(1, "a")]).where("doc_id > 1")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_folders_are_removed(spark, tmp_path):
    import os

    from routeloom.llm.common import shared_dir

    small(str(tmp_path), spark)
    folder = shared_dir(spark).removeprefix("file:")
    had = set(os.listdir(folder))
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    new = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - had if "-" in n and not n[8:9] == "-"}
    assert new <= {"pipeline-sanitise", "pieces", "ranked-pieces"}, new
