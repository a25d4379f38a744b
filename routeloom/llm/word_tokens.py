"""Token ids of a word-level tokenizer of the tokenizers library, whole texts in bounded memory.

A tokenizer that drops white space and encodes the stretches between it independently gives
a text the ids of its stretches, one after another. So each different stretch is encoded
once by the library and kept in a cache of bounded size that outlives a task within its
Python worker; a text costs look-ups only.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of the younger half of the cache; the older half has as many at most.
CACHE_ENTRIES = 400_000
#: Bytes of text that are looked up at once.
PIECE_BYTES = 4 << 20
WHITE = b" \t\n\x0b\x0c\r"
#: Marks that are stretches of their own to the tokenizer when they end a word.
CLOSING = ".,"
#: The first letter whose lower case has more than one character; those before it behave alike everywhere.
FIRST_ODD = "\u0130"
#: The tokenizer's stretches of a printable ASCII word in lower case: its pattern for that alphabet.
ASCII_STRETCH = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    _kept: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        #: which ids end a stretch
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = {"": b"", **dict(zip(CLOSING, self._each(list(CLOSING))))}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _stretches(self, words: list[str]) -> list[bytes]:
        """The ids of words that are one stretch each: many at once, parted by the tokens that end a stretch."""
        out: list[bytes] = []
        lines = [words[k : k + 256] for k in range(0, len(words), 256)]
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(line) for line in lines], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(line):
                out += self._each(line)
                continue
            data, ends = ids.tobytes(), (4 * ends).tolist()
            out += [data[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Puts different words that the younger half of the cache doesn't have into it, or into a new one when it is full."""
        if len(self.young) > CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        again = list(map(old.get, words))
        young.update((w, ids) for w, ids in zip(words, again) if ids is not None)
        new = [w for w, ids in zip(words, again) if ids is None]
        plain, stems, marks, mixed, parts, other = [], [], [], [], [], []
        for w, text in zip(new, b" ".join(new).decode().split(" ")):
            mark = text[-1:]
            if mark in CLOSING:
                stem = text[:-1]
            else:
                stem, mark = text, ""
            # Letters that have no other form when composed and whose case does not depend on their neighbours
            # are encoded in lower case, and a closing mark apart.
            if stem.isalpha() and (stem.isascii() or max(stem) < FIRST_ODD):
                plain.append(w)
                stems.append(stem.lower())
                marks.append(mark)
            elif text.isascii() and text.isprintable() and not any(map(text.__contains__, self.added)):
                mixed.append(w)
                parts.append(ASCII_STRETCH.findall(text.lower()))
            else:
                other.append(w)
        different = list({*stems, *chain.from_iterable(parts)})
        known = {stem: young.get(key) or old.get(key) for stem, key in zip(different, " ".join(different).encode().split(b" "))}
        unknown = [stem for stem in different if known[stem] is None]
        known.update(zip(unknown, self._stretches(unknown)))
        mark_ids = self.marks
        young.update((w, known[stem] + mark_ids[mark] if mark else known[stem]) for w, stem, mark in zip(plain, stems, marks))
        young.update((w, b"".join([known[part] for part in p])) for w, p in zip(mixed, parts))
        for k in range(0, len(other), 4096):
            part = other[k : k + 4096]
            young.update(zip(part, self._each([w.decode() for w in part])))

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words."""
        found = list(map(self.young.get, words))
        if None in found:
            self._learn([w for w, ids in zip(words, found) if ids is None])
            young = self.young  # has what was missing, and perhaps only that
            found = [young[w] if ids is None else ids for w, ids in zip(words, found)]
        return found

    def encode(self, texts: list[bytes] | pa.Array) -> list[bytes]:
        """The ids of each text; texts together should be of about PIECE_BYTES. Each different word of theirs is looked up once."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.binary()).cast(pa.string())
        split = pc.ascii_split_whitespace(texts)  # with empty words where white space begins or ends a text
        words = split.flatten().dictionary_encode()
        if not len(words):
            return [b""] * len(texts)
        found = self._ids_of(_spaced(words.dictionary).split(b" "))
        sizes = np.fromiter(map(len, found), np.int32, len(found)) >> 2
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        which = words.indices.to_numpy()
        n = sizes[which]
        ends = np.cumsum(n, dtype=np.int32)
        # the places of the words' ids among those of the different words
        at = np.repeat(starts[which] - (ends - n), n)
        at += np.arange(len(at), dtype=np.int32)
        data = np.frombuffer(b"".join(found), "<u4")[at].tobytes()
        last = np.cumsum(pc.list_value_length(split).to_numpy())
        cuts = (4 * np.concatenate([[0], ends])[np.concatenate([[0], last])]).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def _spaced(words: pa.Array) -> bytes:
    """The words, parted by spaces."""
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(one, " ").cast(pa.binary())[0].as_py()


def _cut(text: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut at white space."""
    start = 0
    while len(text) - start > PIECE_BYTES:
        end = start + PIECE_BYTES
        while end < len(text) and text[end] not in WHITE:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def encoded(batch: pa.RecordBatch, encoder: WordEncoder, text_column: int = 1) -> Iterator[tuple[int, bytes]]:
    """(row, ids) for each row of a batch, in order."""
    texts = batch.column(text_column).cast(pa.string())
    sizes = pc.binary_length(texts).to_numpy().tolist()
    first = size = 0
    for row, n in enumerate([*sizes, PIECE_BYTES + 1]):  # what ends the batch is like a long text
        if size + n > PIECE_BYTES and row > first:
            yield from enumerate(encoder.encode(texts.slice(first, row - first)), first)
            first, size = row, 0
        if n > PIECE_BYTES and row < len(sizes):
            yield row, b"".join(encoder.encode([part])[0] for part in _cut(texts[row].as_py().encode()))
            first = row + 1
        else:
            size += n
