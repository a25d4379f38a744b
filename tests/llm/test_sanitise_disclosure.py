"""Terms that disclose an entity: values that occur once, and terms apart from them; against a plain version; many matches in a text."""

import math
import random
import re
import time

from pyspark.sql import functions as F

from routeloom.llm import sanitise

FILL = [(100 + i, f"the note and ask the many others quite soon, a number {i}") for i in range(200)]


def added(spark, rows):
    df = spark.createDataFrame(rows + FILL, "doc_id bigint, text string").withColumn("row", F.lit("x"))
    found = {r.doc_id: r for r in sanitise.spans(df).collect()}
    return [{text[s.start : s.end]: s.value for s in found[i].added} for i, text in rows]


def test_a_value_of_one_text(spark):
    got = added(spark, [(0, "the note and ask Quillon Marsh at qm@corp.example soon"), (1, "the note and ask the others soon")])
    assert got == [{"Quillon": "generalise", "Marsh": "generalise"}, {}]


def test_the_nearest_terms_at_any_distance(spark):
    got = added(spark, [(0, "ask Quillon" + " 1234567" * 30 + " qm@corp.example" + "\n" * 100 + "Incomprehensibilities Antidisestablishmentarianism")])
    assert set(got[0]) == {"Quillon", "Incomprehensibilities", "Antidisestablishmentarianism"}


def test_a_heading_apart_from_the_value(spark):
    rows = [(i, f"Quillon: the note and ask the others soon, a number {i} and the others at qm@corp.example") for i in range(4)]
    got = added(spark, rows)
    assert all(g == {"Quillon": "remove"} for g in got)
    # in some texts inside the window, in others outside: both are counted
    rows = [(0, "Quillon qm@corp.example"), (1, "Quillon ask the others soon, the note and number qm@corp.example"), (2, "ask Quillon or the others soon, the note and number qm@corp.example")]
    assert all("Quillon" in g for g in added(spark, rows))


def test_repeated_rows(spark):
    df = spark.createDataFrame([(None, "ask Quillon at qm@corp.example")] * 2 + [(5, None)] + FILL, "doc_id bigint, text string")
    rows = sanitise.spans(df).collect()
    assert len(rows) == 203 and [len(r.added) for r in rows if r.base] == [1, 1]


def plain(rows, limits=sanitise.Thresholds()):
    """(row, start, end, action, replacement) of all added spans, by loops over documents."""
    word = re.compile(r"[^\W\d_]{3,}")
    docs = []
    for _, t in rows:
        t = t or ""
        spans = []
        for kind, pattern in (("email", r"[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"\d+(?:\.\d+){3}")):
            spans += [(m.start(), m.end(), f"{kind}:{m[0].lower()}") for m in re.finditer(pattern, t)]
        terms = [(m.start(), m.end(), m[0].lower()) for m in word.finditer(t)]
        docs.append((t, spans, [x for x in terms if not any(a < x[1] and x[0] < b for a, b, _ in spans)], {x[2] for x in terms}))
    n = len(docs)
    df = lambda has: sum(map(has, docs))
    words = {w: df(lambda d: w in d[3]) for w in {w for d in docs for w in d[3]}}
    found = {}
    for e in {s[2] for d in docs for s in d[1]}:
        own = [d for d in docs if any(s[2] == e for s in d[1])]
        for w in {w for d in own for w in d[3]}:
            co, texts = sum(w in d[3] for d in own), len({d[0] for d in own if w in d[3]})
            value = math.log(n * (co + limits.prior * len(own) / n) / (words[w] + limits.prior) / len(own)) / math.log(n / len(own))
            if value >= limits.generalise_at:
                found[e, w] = (texts, value, len(own) ** limits.generalise_at * n ** (1 - limits.generalise_at) + 1)
    out = []
    for row, (_, spans, terms, _) in enumerate(docs):
        judged = {}
        for start, _, e in spans:
            before = sum(x[0] < start for x in terms)
            beside = {x[2] for x in terms[max(0, before - limits.window) : before + limits.window]}
            for (of, w), (texts, value, needed) in found.items():
                if of == e and (w in beside or texts >= limits.far_texts):
                    v, k = judged.get(w, (0, 0))
                    judged[w] = (max(v, value), max(k, needed))
        for a, b, w in terms:
            if w in judged:
                value, needed = judged[w]
                begins = [w[:k] for k in range(len(w) - 1, 0, -1) if any(x.startswith(w[:k]) and c > needed for x, c in words.items())]
                to = begins[0] + "*" if value < limits.remove_at and begins else ""
                out.append((row, a, b, "generalise" if to else "remove", to))
    return sorted(out)


def test_against_the_plain_version(spark):
    rng = random.Random(12)
    names = [rng.choice(("Quil", "Mars", "Note", "Zzyz")) + chr(97 + k % 26) + chr(97 + k // 26) + "on" for k in range(40)]
    common = "the note and ask others soon number quite marshal".split()
    texts = []
    for i in range(150):
        t = [rng.choice(common) for _ in range(rng.randrange(3, 25))]
        for _ in range(rng.choice((0, 0, 0, 1, 2))):
            k = rng.randrange(40)
            t.insert(rng.randrange(len(t)), rng.choice((f"p{k}@corp.example", f"10.0.0.{k}", f"u{i}@x.example")))
            t.insert(rng.randrange(len(t)), names[k])
            if rng.random() < 0.3:
                t.insert(rng.randrange(len(t)), rng.choice(names))
        texts.append(" ".join(t))
    rows = list(enumerate([*texts, texts[3], texts[3], None, ""]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = {r.doc_id: r for r in sanitise.spans(df).collect()}
    got = sorted((i, s.start, s.end, s.value, s.to) for i, _ in rows for s in found[i].added)
    want = plain(rows)
    assert got == want and {w[3] for w in want} == {"generalise", "remove"} and len(want) > 30
    clean = {r.doc_id: r.text for r in sanitise.sanitised(df).collect()}
    for i, t in rows:
        if t is None:
            assert clean[i] is None
            continue
        for s in sorted([*found[i].base, *found[i].added], key=lambda s: -s.start):
            t = t[: s.start] + s.to + t[s.end :]
        assert clean[i] == t


def test_a_term_is_replaced_wherever_it_stands(spark):
    text = "Quillon: the note and ask the others soon, the number and the others, ask Quillon at qm@corp.example and the others soon and the note, Quillon"
    df = spark.createDataFrame([(0, text), *FILL], "doc_id bigint, text string")
    assert "quillon" not in next(r.text for r in sanitise.sanitised(df).collect() if r.doc_id == 0).lower()


def test_many_matches(spark):
    """16,000 addresses in one text, and spans of several kinds that overlap across blocks."""
    texts = [" ".join(f"10.{i // 250}.{i % 250}.7" for i in range(16000)), "é" * 5 + " ".join(f"a{i}@x.example +1 (068) 555-27{i % 90 + 10}, 4111 1111 1111 1111" for i in range(700))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    only = sanitise.Thresholds(least_texts=10**6, far_texts=10**6)
    one = df.select(F.size(sanitise._found(F.col("text"), "ip")))
    one.collect()
    began = time.time()
    assert [r[0] for r in one.collect()] == [16000, 0]
    assert time.time() - began < 5  # not the square of the matches
    clean = {r.doc_id: r.text for r in sanitise.sanitised(df, limits=only).collect()}
    assert clean[0] == " ".join(["[IP]"] * 16000)
    assert clean[1] == "é" * 5 + " ".join(["[EMAIL] [PHONE], [CARD]"] * 700)
