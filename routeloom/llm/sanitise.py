"""Personal data: patterns, and information-theoretic sanitisation of the terms around them.

The base finds e-mail addresses, IP addresses, payment cards and phone numbers. Each value
found is a protected entity. Terms (runs of letters) that stand near an entity can reveal
it even when it is masked. How strongly a term t reveals an entity e is estimated from the
corpus: the pointwise mutual information of t and e, as a share of the entity's own
information,

    disclosure(e; t) = log(N p(e | t) / df(e)) / log(N / df(e)),
    p(e | t) = (co(e, t) + a df(e) / N) / (df(t) + a),

with document counts df and co over the whole corpus. It is near 1 when t occurs with e
only. Most values occur in one text, so pairs that occur once count too; `a` documents of
no information (`prior`) hold their estimate below that of pairs that repeat. Terms at or
over `remove_at` are removed. Terms at or over `generalise_at` are replaced by a broader
class: the words with the same beginning, written as that with a star. It is the longest
beginning that is no longer disclosing, for which some word with it must occur in so many
documents that a term of that frequency would stay below `generalise_at` even if all the
entity's documents had it. A term without such a class is removed.

Judged are the `window` terms next to the entity on either side, however far off they
are, if the pair occurs in `least_texts` different texts, and all terms of the entity's
documents that occur with it in `far_texts` different ones. What is decided for a term
holds for the whole document, wherever the term stands in it.

Everything is column expressions and joins; no Python runs on the executors. Patterns are
written with possessive quantifiers, so they neither backtrack nor recurse on long texts.
Positions are summed up in blocks of matches, so that a text with many takes no time in
proportion to their square.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored

KINDS = ("email", "ip", "card", "phone")
ADDED = "term"

_LOCAL = r"[A-Za-z0-9._%+-]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Each finds what the kind's rule finds from left to right. Where a run of characters fails, none of its later positions
#: can match; starts are bound to the beginnings of runs, which keeps long runs linear.
PATTERNS = {
    # a local part begins after the match before, too
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # only whole runs of digits with single spaces or hyphens count, of 13 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PLACEHOLDER = {kind: f"[{kind.upper()}]" for kind in KINDS}
TERM = r"\p{L}{3,}"
SPAN = "struct<kind:string,start:int,end:int,value:string,to:string>"
#: Matches whose positions are summed up together.
BLOCK = 128


@dataclass(frozen=True)
class Thresholds:
    generalise_at: float = 0.8
    remove_at: float = 0.98
    least_texts: int = 1
    far_texts: int = 3
    prior: float = 0.25
    #: terms on each side of an entity
    window: int = 4


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Whether the digits pass the Luhn check: from the right, every second one is doubled."""
    values = F.transform(F.split(F.reverse(_digits(m)), ""), lambda d, i: F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)) * (1 + i % 2))
    return F.aggregate(values, F.lit(0), lambda s, v: s + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _found(text: Column, kind: str) -> Column:
    """The spans of a kind: array of (kind, start, end, value), in code points, from what the pattern matches and what it leaves between."""
    pattern = PATTERNS[kind]
    matches, between = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    # each match with its length and that of what stands before it
    pairs = F.zip_with(matches, between, lambda m, b: F.struct(m.alias("m"), F.length(m).alias("size"), F.length(b).alias("before")))
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["before"]
        end = begin + x["size"]
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["m"].alias("value"), F.lit(PLACEHOLDER[kind]).alias("to"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    def positions(blocks: Column, starts: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda b, i: F.aggregate(b, F.struct(starts[i].alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    def starts(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["before"] + x["size"]))
        return F.aggregate(sizes, F.array(F.lit(0)), lambda out, n: F.array_append(out, F.element_at(out, -1) + n))

    # what follows the last match has no match of its own
    spans = _let(F.filter(pairs, lambda x: x["m"].isNotNull()), lambda p: _let(_blocks(p), lambda blocks: _let(starts(blocks), lambda at: positions(blocks, at))))
    need = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, F.lit(True))
    return F.when(need & text.rlike(pattern), F.filter(spans, lambda s: _passes(kind, s["value"]))).otherwise(none)


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), with x evaluated once."""
    return F.element_at(F.transform(F.array(x), then), 1)


def _blocks(items: Column) -> Column:
    """An array that isn't empty, cut into arrays of BLOCK items."""
    last = F.floor((F.size(items) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * BLOCK + 1, BLOCK))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, text): what is found in a text depends on the text only; id and hash join it to its row again."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), t.alias("text")).withColumn("h", F.xxhash64("text"))


def _places(some: DataFrame) -> DataFrame:
    """some(row, text, base) -> (row, start, end, term, entity, n): the terms outside all spans, numbered in order; for a span, n is the number of terms before it."""
    matches, between = F.regexp_extract_all("text", F.lit(TERM), 0), F.split("text", TERM, -1)
    pairs = F.zip_with(matches, F.slice(between, 1, F.size(matches)), lambda m, b: F.struct(m.alias("m"), F.length(m).alias("size"), (F.length(b) + F.length(m)).alias("step")))
    parts = some.select("row", F.posexplode(pairs).alias("i", "p"))
    end = F.sum("p.step").over(Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    none = F.lit(None).cast("string")
    terms = parts.select("row", end.alias("end"), "p.size", F.lower("p.m").alias("term")).select("row", (F.col("end") - F.col("size")).alias("start"), "end", "term", none.alias("entity"))
    spans = some.select("row", F.explode("base").alias("s")).select("row", "s.start", "s.end", none.alias("term"), _entity(F.col("s")).alias("entity"))
    so_far = Window.partitionBy("row").orderBy("start", F.col("term").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce(F.max(F.when(F.col("term").isNull(), F.col("end"))).over(so_far) > F.col("start"), F.lit(False))
    events = terms.union(spans).withColumn("open", F.col("term").isNotNull() & ~inside)
    return events.withColumn("n", F.sum(F.col("open").cast("int")).over(so_far)).where(F.col("open") | F.col("term").isNull()).drop("open")


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.lower(span["value"]))


def _words() -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), 0), F.lower))


def _disclosing(some: DataFrame, counts: DataFrame, n: float, limits: Thresholds) -> DataFrame:
    """(entity, term, texts, disclosure, needed) for pairs at or over the lower threshold. All counts are of documents. needed: a class in more documents discloses less."""
    of_doc = some.select("row", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    of_doc = of_doc.join(of_doc.groupBy("entity").agg(F.count("*").alias("df_e")), "entity")
    terms = some.select("row", "h", F.explode(_words()).alias("term")).join(counts, "term")
    # co is df_e at most; terms too frequent to reach the threshold even then make no pair
    most = F.pow("df_e", F.lit(limits.generalise_at)) * F.pow(F.lit(n), F.lit(1 - limits.generalise_at))
    pairs = of_doc.join(terms, "row").where((F.col("df_t") <= most + 1) & (F.col("df_e") < n))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("co"), F.countDistinct("h").alias("texts"), F.first("df_e").alias("df_e"), F.first("df_t").alias("df_t"))
    share = (F.col("co") + limits.prior * F.col("df_e") / F.lit(n)) / (F.col("df_t") + limits.prior)
    value = F.log(F.lit(n) * share / F.col("df_e")) / F.log(F.lit(n) / F.col("df_e"))
    found = pairs.select("entity", "term", "texts", value.alias("disclosure"), (most + 1).alias("needed"))
    return found.where((F.col("disclosure") >= limits.generalise_at) & (F.col("texts") >= limits.least_texts))


def _generalised(flagged: DataFrame, counts: DataFrame, n: float, limits: Thresholds) -> DataFrame:
    """(term, needed, to) of the terms that have a broader class: their longest beginning with which some word occurs in more than `needed` documents."""
    beginnings = lambda most: F.explode(F.transform(F.sequence(F.lit(1), most), lambda k: F.left("term", k))).alias("begin")
    frequent = counts.where(F.col("df_t") > n ** (1 - limits.generalise_at))  # a class needs no fewer
    classes = frequent.select(beginnings(F.length("term")), "df_t").groupBy("begin").agg(F.max("df_t").alias("df"))
    asked = flagged.where(F.col("disclosure") < limits.remove_at).select("term", "needed").distinct().select("term", "needed", beginnings(F.length("term") - 1))
    met = asked.join(classes, "begin").where(F.col("df") > F.col("needed"))
    return met.groupBy("term", "needed").agg(F.concat(F.max_by("begin", F.length("begin")), F.lit("*")).alias("to"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Thresholds = Thresholds()) -> DataFrame:
    """One row for each row of docs: doc_id, h (hash of the text), base and added, arrays of (kind, start, end, value, to).

    Starts and ends are code points, ends exclusive; base has the kinds in the order of KINDS, then by start; added has terms
    by start, the value saying what happens: `generalise` or `remove`. `to` is what replaces the span. A null text is empty. Null ids and repeated rows are
    returned like any other. An empty table gives an empty result. Other columns are ignored.
    """
    texts = _texts(docs, id_col, text_col)
    base = texts.select("doc_id", "h", "text", F.concat(*(_found(F.col("text"), k) for k in KINDS)).alias("base"))
    # rows get a number, fixed by writing them; texts are needed further where something is found
    held = F.when(F.size("base") > 0, F.col("text")).alias("text")
    base = stored(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "h", "base", held), "base-spans")
    some = base.where(F.size("base") > 0)
    places = stored(_places(some), "places")
    terms, entities = places.where("term is not null").drop("entity"), places.where("entity is not null").select("row", "entity", "n")
    n = float(texts.count())
    # documents of each word, combined before the shuffle
    counts = stored(texts.select(F.explode(_words()).alias("term")).groupBy("term").agg(F.count("*").alias("df_t")), "words")
    found = cut(_disclosing(some, counts, n, limits))
    beside = F.explode(F.sequence(F.col("n") - limits.window + 1, F.col("n") + limits.window)).alias("n")
    near = entities.select("row", "entity", beside).join(terms, ["row", "n"]).select("row", "entity", "term").distinct().join(found, ["entity", "term"])
    far = entities.select("row", "entity").distinct().join(found.where(F.col("texts") >= limits.far_texts), "entity")
    columns = ["row", "term", "disclosure", "needed"]
    flagged = cut(near.select(*columns).union(far.select(*columns)).groupBy("row", "term").agg(F.max("disclosure").alias("disclosure"), F.max("needed").alias("needed")))
    flagged = flagged.join(_generalised(flagged, counts, n, limits), ["term", "needed"], "left")
    everywhere = terms.join(flagged, ["row", "term"])
    action = F.when(F.col("to").isNull(), "remove").otherwise("generalise")
    span = F.struct(F.lit(ADDED).alias("kind"), "start", "end", action.alias("value"), F.coalesce("to", F.lit("")).alias("to"))
    of_row = everywhere.select("row", span.alias("s")).groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("added"))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    return base.drop("text").join(of_row, "row", "left").select("doc_id", "h", "base", F.coalesce("added", none).alias("added"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, from the rows of spans()."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"), F.size("added").cast("bigint").alias("n_added")
    )


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Thresholds = Thresholds()) -> DataFrame:
    """docs with the personal data of their texts replaced by placeholders; all rows and columns stay, a null text stays null."""
    found = spans(docs, id_col, text_col, limits).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.concat("base", "added").alias("_s")).where(F.size("_s") > 0).dropDuplicates(["_id", "_h"])
    # spans that overlap become one, replaced as the first of them is
    key = ["_id", "_h"]
    of_text = Window.partitionBy(*key).orderBy("start", F.desc("end"), "kind")
    each = found.select(*key, F.explode("_s").alias("s")).select(*key, "s.start", "s.end", "s.kind", "s.to")
    opens = F.coalesce(F.col("start") >= F.max("end").over(of_text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    each = each.withColumn("opens", opens).withColumn("g", F.sum(F.col("opens").cast("int")).over(of_text.rowsBetween(Window.unboundedPreceding, 0)))
    merged = each.groupBy(*key, "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.when(F.col("opens"), F.col("to"))).alias("to"))
    found = merged.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "to"))).alias("_m"))
    # the rows' own columns travel as one, so that none can clash
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("t", F.lit(""))))
    joined = rows.join(found, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    t = F.col("t")

    def part(block: Column, begin: Column) -> Column:
        """The text from begin to the end of a block's last span, replaced; positions are those within it."""
        piece = F.substring(t, begin + 1, F.element_at(block, -1)["end"] - begin)

        def of(within: Column) -> Column:
            before = lambda i: F.when(i > 0, F.try_element_at(block, i)["end"]).otherwise(begin)  # noqa: E731  the end of the span before
            return F.array_join(F.transform(block, lambda s, i: F.concat(F.substring(within, before(i) - begin + 1, s["start"] - before(i)), s["to"])), "")

        return _let(piece, of)

    def clean(blocks: Column) -> Column:
        begin = lambda i: F.when(i > 0, F.element_at(F.try_element_at(blocks, i), -1)["end"]).otherwise(0)
        return F.array_join(F.transform(blocks, lambda b, i: part(b, begin(i))), "")

    last = F.element_at("_m", -1)["end"]
    text = F.when(F.col("_m").isNotNull(), F.concat(_let(_blocks(F.col("_m")), clean), F.substring(t, last + 1, F.length(t) - last))).otherwise(t)
    return joined.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
