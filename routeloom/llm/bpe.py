"""Byte-level BPE encoding and decoding by DuckDB queries within each partition.

A text is cut into words by the tokenizer's pattern; words don't influence each other, so
each different word of a partition is encoded once and kept in a bounded cache. Words are
encoded many at a time by one recursive query: its rows are the tokens of all words, with
their positions and those of the tokens that follow; a step joins tokens with their
successors and with the merge table, takes each word's pair of least rank (the leftmost of
equals), and contracts it; words without such a pair leave the recursion. Decoding joins
ids with the vocabulary and aggregates by position.

Words over `LONG` bytes take a second query that contracts all pairs of least rank of a
word in a step, from the left where they overlap. That is the same as one after another
as long as no new token makes a pair of a lower rank with a neighbour; the step ends with
the first that does. A long word so takes about as many steps as it has different ranks,
not as it has merges.

Every connection has one thread and bounded memory, and belongs to its Python worker;
nothing is written to disk.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import accumulate, chain, filterfalse, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_worker, keyed_texts

#: Entries of the younger half of the cache; the older half has as many at most.
CACHE_ENTRIES = 400_000
#: Characters of text that are cut into words at once.
PIECE_CHARS = 1 << 20
#: Rows that one recursive query may make.
QUERY_ROWS = 2_000_000
#: Ids that are decoded at once.
DECODE_IDS = 500_000

#: Words over this size take the second query.
LONG = 64

#: s: place (word and position in one number), word, token, place of the next token, whether the word is done.
ENCODE = """
WITH RECURSIVE s(k, w, t, nk, done, step) AS (
    SELECT (w::BIGINT << 32) | p, w, t, (w::BIGINT << 32) | np, false, 0 FROM start
  UNION ALL (
    WITH live AS (SELECT * FROM s WHERE NOT done AND step < {steps}),
    ranked AS (
        SELECT a.k, a.w, a.t, a.nk, a.step, n.nk AS nnk, (m.r::BIGINT << 32) | (a.k & 4294967295) AS o
        FROM live a LEFT JOIN live n ON a.nk = n.k LEFT JOIN merges m ON m.pair = ((a.t::BIGINT << 32) | n.t)),
    best AS (SELECT w, min(o) AS o, (min(o) >> 32)::INT AS br, arg_min(nk, o) AS gone FROM ranked GROUP BY w)
    SELECT r.k, r.w, CASE WHEN r.o = b.o THEN br ELSE t END, CASE WHEN r.o = b.o THEN nnk ELSE nk END, b.o IS NULL, step + 1
    FROM ranked r JOIN best b ON r.w = b.w WHERE b.gone IS DISTINCT FROM r.k))
SELECT w, (k & 4294967295)::INT AS p, t, done FROM s WHERE done OR step = {steps} ORDER BY w, p
"""

#: The same for long words. place: 1, 2, ... in a run of neighbouring pairs of least rank, of which every second one is contracted; then
#: no pair after (by position) the first whose new token makes a pair of a lower rank with its neighbours.
ENCODE_LONG = """
WITH RECURSIVE s(w, p, t, done, step) AS (
    SELECT w, p, t, false, 0 FROM start
  UNION ALL (
    WITH near AS (
        SELECT w, p, t, step, lead(t) OVER x AS nt, lead(t, 2) OVER x AS nnt, lag(t) OVER x AS pt, row_number() OVER x AS n FROM s WHERE NOT done AND step < {steps}
        WINDOW x AS (PARTITION BY w ORDER BY p)),
    ranked AS (
        SELECT near.*, m.r, m.alone FROM near LEFT JOIN merges m ON m.pair = ((near.t::BIGINT << 32) | near.nt)),
    best AS (SELECT w, min(r) AS br FROM ranked GROUP BY w),
    hit AS (SELECT r.*, b.br, coalesce(r.r = b.br, false) AS h FROM ranked r JOIN best b ON r.w = b.w),
    runs AS (
        SELECT *, h AND (n - max(CASE WHEN h THEN 0 ELSE n END) OVER (PARTITION BY w ORDER BY p ROWS UNBOUNDED PRECEDING)) % 2 = 1 AS joins FROM hit),
    kept AS (SELECT *, lag(joins) OVER x AS gone, lag(joins, 2) OVER x AS beside, lag(p) OVER x AS lag_p FROM runs WINDOW x AS (PARTITION BY w ORDER BY p)),
    lower AS (
        SELECT k.w, min(k.p) AS lp FROM kept k LEFT JOIN merges a ON a.pair = ((CASE WHEN beside THEN k.br ELSE k.pt END)::BIGINT << 32) | k.br
        LEFT JOIN merges b ON b.pair = ((k.br::BIGINT << 32) | k.nnt) WHERE k.joins AND k.alone AND (a.r < k.br OR b.r < k.br) GROUP BY k.w)
    SELECT k.w, p, CASE WHEN joins AND (lp IS NULL OR p <= lp) THEN br ELSE t END, br IS NULL, step + 1
    FROM kept k LEFT JOIN lower l ON k.w = l.w WHERE gone IS NOT TRUE OR (lp IS NOT NULL AND p > lp AND lag_p > lp)))
SELECT w, p, t, done FROM s WHERE done OR step = {steps} ORDER BY w, p
"""

DECODE = "SELECT doc, unhex(string_agg(hex, '' ORDER BY p)) AS bytes FROM ids JOIN vocabulary USING (id) GROUP BY doc"


class Codec:
    _kept: dict[tuple[str, str], Codec] = {}

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        left, right, rank = (np.array(x, np.int64) for x in (left, right, rank))
        # the least rank of the pairs that each token is in; a token with a lower one than its own is contracted alone
        least = np.full(int(max(ranks.values())) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, left, rank)
        np.minimum.at(least, right, rank)
        merges = pa.table({"pair": left << 32 | right, "r": rank.astype(np.int32), "alone": least[rank] < rank})
        vocabulary = pa.table({"id": np.array(list(ranks.values()), np.int32), "hex": [t.hex() for t in ranks]})
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given ORDER BY 1")
            self.db.unregister("given")
        # what is added to the ids of a word by a mark after it
        self.marks = {mark: f" {ranks[mark.encode()]}" for mark in ".,"}
        # a word's ids as text, under the word without the space before it, for words after one space; and under the word as it stands
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    @classmethod
    def of(cls, ranks_path: str, pattern: str) -> Codec:
        if (ranks_path, pattern) not in cls._kept:
            cls._kept[ranks_path, pattern] = cls(ranks_path, pattern)
        return cls._kept[ranks_path, pattern]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, by recursive queries."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        part: list[int] = []
        rows = 0
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable").tolist()
        for i in order:
            size = len(words[i])
            made = size * min(size, 40)  # about as many rows as the recursion makes of it
            if part and (rows + made > QUERY_ROWS or len(words[part[-1]]) <= LONG < size):
                self._query(words, part, out)
                part, rows = [], 0
            part.append(i)
            rows += made
        if part:
            self._query(words, part, out)
        return out

    def _query(self, words: list[bytes], part: list[int], out: list[np.ndarray]) -> None:
        long = len(words[part[-1]]) > LONG
        flat = np.frombuffer(b"".join([words[i] for i in part]), np.uint8)
        size = np.fromiter((len(words[i]) for i in part), np.int64, len(part))
        w, end = np.repeat(np.arange(len(part)), size), np.cumsum(size)
        p, t = np.arange(len(flat)) - np.repeat(end - size, size), self.byte_ids[flat]
        while len(w):
            start = {"w": pa.array(w, pa.int32()), "p": pa.array(p, pa.int32()), "t": pa.array(t, pa.int32())}
            if not long:
                start["np"] = pa.array(np.append(p[1:], 0), pa.int32(), mask=np.append(w[1:] != w[:-1], True))
            self.db.register("start", pa.table(start))
            # bounds the rows that are held; what isn't done goes on
            steps = max(2, QUERY_ROWS // len(w))
            got = self.db.sql((ENCODE_LONG if long else ENCODE).format(steps=steps)).to_arrow_table()
            self.db.unregister("start")
            w, p, t, done = (got.column(n).to_numpy() for n in ("w", "p", "t", "done"))
            edge = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.empty(0, np.int64)
            ended = done[edge]
            for i, a, b in zip(w[edge[ended]].tolist(), edge[ended].tolist(), np.append(edge[1:], len(w))[ended].tolist()):
                out[part[i]] = t[a:b]
            w, p, t = w[~done], p[~done], t[~done]

    def _learn(self, pieces: set[str], turn: bool) -> None:
        """Puts pieces of text (words and marks without white space at either end) into the cache, each with a space before it."""
        if turn and len(self.young) > CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        again = pieces & old.keys()
        young.update(zip(again, map(old.__getitem__, again)))
        marks, find = self.marks, self.find
        stems, marked, cut = set(), [], {}
        for piece in pieces - again:
            # letters after a space are one word, and a mark after them is another
            if piece.isascii() and piece.isalpha():
                stems.add(piece)
            elif (ending := marks.get(piece[-1])) is not None and (stem := piece[:-1]).isascii() and stem.isalpha():
                stems.add(stem)
                marked.append((piece, stem, ending))
            else:
                cut[piece] = find(" " + piece)
        # a word without its mark may be known
        for stem in stems & old.keys():
            young.setdefault(stem, old[stem])
        stems -= young.keys()
        new = list({" " + stem for stem in stems}.union(*cut.values()))
        ids = dict(zip(new, self._texts(new)))
        young.update((stem, ids[" " + stem]) for stem in stems)
        young.update((piece, young[stem] + ending) for piece, stem, ending in marked)
        young.update((piece, " ".join([ids[w] for w in found])) for piece, found in cut.items())

    def _texts(self, words: list[str]) -> list[str]:
        """The ids of each word, as decimal numbers joined by spaces."""
        found = self.encode_words([w.encode() for w in words])
        numbers = list(map(str, np.concatenate([np.empty(0, np.int32), *found]).tolist()))
        ends = list(accumulate(map(len, found)))
        return [" ".join(numbers[a:b]) for a, b in zip([0, *ends], ends)]

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text, as decimal numbers joined by spaces."""
        # A single space between two other characters always begins a word, so texts are cut there: pieces after a space
        # go through the cache. Other texts (white space in a row) are cut by the pattern.
        split, plain = [], []
        for t in texts:
            s = t.split()
            if not s or " ".join(s) != t:  # other white space than single spaces
                s = t.split(" ")
                plain.append(s != [""] and all(s) and not any(map(str.isspace, {*map(itemgetter(0), s), *map(itemgetter(-1), s)})))
            else:
                plain.append(True)
            split.append(s)
        for turn in (True, False):  # a new generation of the cache may begin when pieces are learned
            missing = set(filterfalse(self.young.__contains__, chain.from_iterable(islice(s, 1, None) for s, ok in zip(split, plain) if ok)))
            if not missing:
                break
            young = self.young
            self._learn(missing, turn)
            if self.young is young:
                break
        rest = [self.find(s[0]) if ok else self.find(t) for t, s, ok in zip(texts, split, plain)]
        different = list({w for found in rest for w in found})
        ids = dict(zip(different, self._texts(different)))
        known, out = self.young.__getitem__, []
        for s, ok, found in zip(split, plain, rest):
            first = " ".join([ids[w] for w in found])
            out.append(" ".join([first, *map(known, s[1:])]) if ok else first)
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        size = np.array([len(i) for i in ids], np.int64)
        out, end = [b""] * len(ids), np.cumsum(size)
        rows = pa.table({"doc": np.repeat(np.arange(len(ids)), size), "p": np.arange(size.sum()) - np.repeat(end - size, size), "id": np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32)})
        self.db.register("ids", rows)
        for doc, data in self.db.execute(DECODE).fetchall():
            out[doc] = data
        self.db.unregister("ids")
        return out


def _parts(text: str):
    """Parts of a long text, cut before a space between two other characters, where words always part."""
    start = 0
    while len(text) - start > PIECE_CHARS:
        end = text.find(" ", start + PIECE_CHARS)
        while end > 0 and (text[end - 1].isspace() or end + 1 == len(text) or text[end + 1].isspace()):
            end = text.find(" ", end + 1)
        if end <= 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def _numbers(ids: str) -> np.ndarray:
    return np.fromstring(ids, np.int32, sep=" ") if ids else np.empty(0, np.int32)


def encoded_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) for each row: for uses that want the ids themselves. See round_trip."""
    return _run(docs, ranks_path, pattern, id_col, text_col, digests=False)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids. Null ids and repeated rows are returned like any other. An empty table gives an
    empty result. Other columns are ignored. No text is cut short. A word of millions of letters without a break takes a
    step for each different rank that it merges by, and memory in proportion to its length: some hundred bytes a letter.
    """
    return _run(docs, ranks_path, pattern, id_col, text_col, digests=True)


def _run(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches):
        codec = Codec.of(ranks_path, pattern)

        def work(doc_ids, texts):
            """Texts of PIECE_CHARS together, or one that is longer."""
            if len(texts) == 1:
                coded = [" ".join(x for part in _parts(texts[0]) for x in codec.encode([part]) if x)]
            else:
                coded = codec.encode(texts)
            numbers = [_numbers(c) for c in coded]
            if sum(map(len, numbers)) <= DECODE_IDS or len(texts) > 1:
                decoded = codec.decode(numbers)
            else:
                decoded = [b"".join(codec.decode([numbers[0][k : k + DECODE_IDS]])[0] for k in range(0, len(numbers[0]), DECODE_IDS))]
            if digests:
                return pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(map(len, numbers), pa.int64()), pa.array([sha(c.encode()) for c in coded]), pa.array([sha(d) for d in decoded])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(numbers, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

        for batch in batches:
            doc_ids, texts, size = [], [], 0
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                if texts and size + len(text) > PIECE_CHARS:
                    yield work(doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
                doc_ids.append(doc_id)
                texts.append(text)
                size += len(text)
            if texts:
                yield work(doc_ids, texts)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "doc_id bigint, ids array<int>, decoded binary"
    return keyed_texts(docs, id_col, text_col).mapInArrow(in_worker(run, Codec), schema)
