"""An adaptive context-mixing range coder for token ids, over many blocks in step.

A block holds a fixed number of ids and is coded on its own: all its state starts anew.
Blocks do not depend on each other, so each operation runs on one id of every block at once,
as vector operations over the blocks ("lanes").

An id is coded as binary decisions. Order-2 and order-1 contexts (the last two ids, the
last id) each predict one id, the one that followed last time, with a confidence: is it that
one? Otherwise the id's class follows (its number of bits, a tree of four decisions) and then
the leading bits after the first; the bits below those are stored as they are. The
probability of a decision is mixed from those of contexts of order 0, 1 and 2: logistic
mixing, adapted after each decision. The mixed probability drives
a carryless range coder with 32-bit bounds.

Everything is integer arithmetic, so that encoder and decoder agree on any machine.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

#: Probabilities have 12 bits; logits are in units of 1/256, within +-2047, and of 1/65536 in the tables.
SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2048, 2048)], np.int32)
#: Slots of the tables of predicted ids; leading bits of an id that are modelled; step of adaptation; ids are below LIMIT.
SLOTS = 1 << 12
MODELLED = 2
RATE = 10
LIMIT = 1 << 16
#: An id's number of bits, less one; 0 and no id (-1) have class 0. At least 1 for ids from 2 on.
CLASS = np.array([max(0, i.bit_length() - 1) for i in range(LIMIT)] + [0], np.int32)
MAGIC, VERSION = b"TIDB", 1
HEADER = struct.Struct("<4sBxHIIIII")  # magic, version, documents, ids, bytes of coded and stored bits, CRC-32 of the ids and of all other bytes
CHECKED = HEADER.size - 4
ENTRY = struct.Struct("<qIB")  # document id, ids here, flags
HAS_ID, FIRST, LAST = 1, 2, 4


class _Mixed:
    """A decision whose logit is the sum of logits under contexts of order 0, 1 and 2, each adapted by the error of the mix.

    This is logistic mixing in which every context carries its own weight. Tables are flat: a lane's part begins at its base.
    """

    def __init__(self, lanes: int, *sizes: int):
        self.tables = [np.zeros(lanes * s, np.int32) for s in sizes]
        self.bases = [np.arange(lanes) * s for s in sizes]

    def predict(self, *contexts) -> np.ndarray:
        self.at = [b + c for b, c in zip(self.bases, contexts)]
        self.seen = [t[a] for t, a in zip(self.tables, self.at)]
        total = sum(self.seen[1:], self.seen[0]) >> 8
        self.p = SQUASH[np.minimum(np.maximum(total, -2047), 2047) + 2048]
        return self.p

    def update(self, bit: np.ndarray, active) -> None:
        step = ((bit << 12) - self.p) * active * RATE
        for table, at, seen in zip(self.tables, self.at, self.seen):
            table[at] = seen + step


class _Model:
    """The state of all lanes. `code` takes the coder's decision: (bit or None, probability, active) -> bit."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.hit2, self.hit1 = _Mixed(lanes, 32, 64), _Mixed(lanes, 32, 64)
        self.kind = _Mixed(lanes, 16, 256, 4096)
        self.lead = _Mixed(lanes, 64, 1024)
        self.base = np.arange(lanes) * SLOTS
        # the id that followed, plus one (0: none yet), and how sure that is in the lowest two bits
        self.next2, self.next1 = (np.zeros(lanes * SLOTS, np.int32) for _ in range(2))
        self.zero, self.one = np.zeros(lanes, np.int32), np.ones(lanes, np.int32)
        self.last = self.before = self.class1 = self.class2 = self.history2 = self.history1 = self.zero

    @staticmethod
    def classes(ids: np.ndarray) -> np.ndarray:
        return CLASS[ids]

    def step(self, ids, code, stored, alive) -> np.ndarray:
        """One id of every lane; ids is None when decoding. stored(lanes' number of bits, value or None, active) -> value."""
        active = self.one if alive is None else alive.astype(np.int32)
        slot2 = self.base + ((self.last * 5087 + self.before * 3011 >> 3) & (SLOTS - 1))
        slot1 = self.base + (self.last * 5087 >> 3 & (SLOTS - 1))
        out, left, guesses = self.zero, active, []
        for mixed, slot, nexts, history in ((self.hit2, slot2, self.next2, self.history2), (self.hit1, slot1, self.next1, self.history1)):
            held = nexts[slot]
            sure, guess = held & 3, (held >> 2) - 1
            p = mixed.predict(sure * 8 + history, sure * 16 + self.classes(guess))
            ask = left * (guess >= 0)
            bit = code(None if ids is None else (ids == guess).astype(np.int32), p, ask)
            mixed.update(bit, ask)
            hit = bit * ask
            out = out + hit * guess
            left = left - hit
            guesses.append((slot, nexts, held, guess, sure))
        # the class
        kinds = None if ids is None else self.classes(ids)
        node, one_back, two_back = self.one, self.class1 * 16, (self.class1 * 16 + self.class2) * 16
        for shift in (3, 2, 1, 0):
            p = self.kind.predict(node, one_back + node, two_back + node)
            bit = code(None if ids is None else kinds >> shift & 1, p, left)
            self.kind.update(bit, left)
            node = node * 2 + bit
        kind = node - 16
        place, one_back = self.one, self.class1 * 64
        for k in range(MODELLED):
            ask = left * (kind > k)
            at = kind * 4 + place
            p = self.lead.predict(at, one_back + at)
            bit = code(None if ids is None else ids >> np.maximum(kind - 1 - k, 0) & 1, p, ask)
            self.lead.update(bit, ask)
            place = np.where(ask == 1, place * 2 + bit, place)
        # what is left of the id below its leading bits; class 0 holds ids 0 and 1: one bit
        rest = np.where(kind == 0, 1, np.maximum(kind - MODELLED, 0))
        low = stored(rest, None if ids is None else ids & (1 << rest) - 1, left)
        value = np.where(kind == 0, low, place << rest | low)
        out = ids if ids is not None else np.where(left == 1, value, out)
        # what the contexts predict from now on
        history = []
        for slot, nexts, held, guess, sure in guesses:
            right = out == guess
            surer = np.where(right, held + (sure < 3), np.where(sure > 0, held - 1, out + 1 << 2))
            nexts[slot] = surer if alive is None else np.where(alive, surer, held)
            history.append(right)
        self.history2, self.history1 = self.history2 * 2 + history[0] & 7, self.history1 * 2 + history[1] & 7
        self.before, self.last = self.last, out
        self.class2, self.class1 = self.class1, self.classes(out)
        return out


FULL = np.uint32(0xFFFFFFFF)


class _Writer:
    def __init__(self, lanes: int, room: int):
        self.low, self.high = np.zeros(lanes, np.uint32), np.full(lanes, FULL)
        self.out, self.at = np.zeros((lanes, room), np.uint8), np.zeros(lanes, np.int64)

    def _emit(self, lanes: np.ndarray, values: np.ndarray) -> None:
        at = self.at[lanes]
        if at.max() >= self.out.shape[1]:
            self.out = np.pad(self.out, ((0, 0), (0, self.out.shape[1])))
        self.out[lanes, at] = values
        self.at[lanes] = at + 1

    def code(self, bit, p, active):
        low, high = self.low, self.high
        span = high - low
        p = p.view(np.uint32)
        middle = low + (span >> 12) * p + ((span & 4095) * p >> 12)
        one, on = bit == 1, active == 1
        self.high = np.where(on & one, middle, high)
        self.low = np.where(on & ~one, middle + 1, low)
        same = np.flatnonzero((self.low ^ self.high) < 1 << 24)
        while len(same):
            high = self.high[same]
            self._emit(same, high >> 24)
            low, high = self.low[same] << 8, high << 8 | 255
            self.low[same], self.high[same] = low, high
            same = same[(low ^ high) < 1 << 24]
        return bit

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.at))
        for shift in (24, 16, 8, 0):
            self._emit(every, self.low >> shift & 255)
        return [row[:n].tobytes() for row, n in zip(self.out, self.at.tolist())]


class _Reader:
    def __init__(self, data: list[bytes]):
        room = max(map(len, data), default=0) + 8
        self.data = np.zeros((len(data), room), np.uint32)
        for row, d in zip(self.data, data):
            row[: len(d)] = np.frombuffer(d, np.uint8)
        lanes = len(data)
        self.low, self.high, self.at = np.zeros(lanes, np.uint32), np.full(lanes, FULL), np.full(lanes, 4, np.int64)
        self.x = self.data[:, 0] << 24 | self.data[:, 1] << 16 | self.data[:, 2] << 8 | self.data[:, 3]

    def code(self, bit, p, active):
        low, high = self.low, self.high
        span = high - low
        p = p.view(np.uint32)
        middle = low + (span >> 12) * p + ((span & 4095) * p >> 12)
        one, on = self.x <= middle, active == 1
        self.high = np.where(on & one, middle, high)
        self.low = np.where(on & ~one, middle + 1, low)
        same = np.flatnonzero((self.low ^ self.high) < 1 << 24)
        while len(same):
            at = self.at[same]
            self.x[same] = self.x[same] << 8 | self.data[same, np.minimum(at, self.data.shape[1] - 1)]
            self.at[same] = at + 1
            low, high = self.low[same] << 8, self.high[same] << 8 | 255
            self.low[same], self.high[same] = low, high
            same = same[(low ^ high) < 1 << 24]
        return (one & on).astype(np.int32)


class _BitsOut:
    def __init__(self, lanes: int, steps: int):
        self.values, self.at = np.zeros((lanes, steps * 2 + 16), np.uint8), np.zeros(lanes, np.int32)
        self.every = np.arange(lanes)

    def put(self, count, value, active):
        count = count * active
        at = self.at >> 3
        word = (value << (24 - count - (self.at & 7))) * (count > 0)  # within three bytes: 7 + 13 bits at most
        for k in range(3):
            self.values[self.every, at + k] |= (word >> (16 - 8 * k) & 255).astype(np.uint8)
        self.at += count
        return value

    def finish(self) -> list[bytes]:
        return [row[: (n + 7) // 8].tobytes() for row, n in zip(self.values, self.at.tolist())]


class _BitsIn:
    def __init__(self, data: list[bytes]):
        room = max(map(len, data), default=0) + 4
        self.data = np.zeros((len(data), room), np.int32)
        for row, d in zip(self.data, data):
            row[: len(d)] = np.frombuffer(d, np.uint8)
        self.at, self.every = np.zeros(len(data), np.int32), np.arange(len(data))

    def get(self, count, value, active):
        count = count * active
        at = np.minimum(self.at >> 3, self.data.shape[1] - 3)
        word = self.data[self.every, at] << 16 | self.data[self.every, at + 1] << 8 | self.data[self.every, at + 2]
        out = word >> (24 - count - (self.at & 7)) & (1 << count) - 1
        self.at += count
        return out


def encode_blocks(blocks: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """(coded, stored) bytes of each block of ids."""
    size = np.array([len(b) for b in blocks], np.int64)
    steps = int(size.max(initial=0))
    ids = np.zeros((steps, len(blocks)), np.int32)
    for lane, b in enumerate(blocks):
        ids[: len(b), lane] = b
    if steps and int(ids.max()) >= LIMIT:
        raise ValueError(f"ids must be below {LIMIT}")
    model, coder, bits = _Model(len(blocks)), _Writer(len(blocks), 64 + 2 * steps), _BitsOut(len(blocks), steps)
    least = int(size.min(initial=0))
    for k in range(steps):
        model.step(ids[k], coder.code, bits.put, None if k < least else k < size)
    return list(zip(coder.finish(), bits.finish()))


def decode_blocks(coded: list[tuple[bytes, bytes]], sizes: list[int]) -> list[np.ndarray]:
    """The ids of blocks of `sizes` ids."""
    size = np.array(sizes, np.int64)
    steps, least = int(size.max(initial=0)), int(size.min(initial=0))
    out = np.zeros((steps, len(coded)), np.int32)
    model, coder, bits = _Model(len(coded)), _Reader([c for c, _ in coded]), _BitsIn([s for _, s in coded])
    for k in range(steps):
        out[k] = model.step(None, coder.code, bits.get, None if k < least else k < size)
    return [out[:n, lane].astype(np.uint32) for lane, n in enumerate(sizes)]


def pack(entries: list[tuple[int | None, int, bool, bool]], ids: np.ndarray, coded: tuple[bytes, bytes]) -> bytes:
    """A block's bytes. entries: (document id, ids here, first part, last part)."""
    table = b"".join(ENTRY.pack(d or 0, n, (d is not None) * HAS_ID | first * FIRST | last * LAST) for d, n, first, last in entries)
    body = table + coded[0] + coded[1]
    head = HEADER.pack(MAGIC, VERSION, len(entries), len(ids), len(coded[0]), len(coded[1]), zlib.crc32(ids.astype("<u4").tobytes()), 0)[:CHECKED]
    return head + struct.pack("<I", zlib.crc32(body, zlib.crc32(head))) + body


def unpack(data: bytes) -> tuple[list[tuple[int | None, int, bool, bool]], int, int, tuple[bytes, bytes]]:
    """(entries, ids, their CRC-32, coded) of a block; raises ValueError when the bytes are damaged."""
    if len(data) < HEADER.size:
        raise ValueError("a block is cut short")
    magic, version, documents, n, coded, stored, ids_crc, crc = HEADER.unpack_from(data)
    body = data[HEADER.size :]
    if magic != MAGIC or version != VERSION or len(body) != documents * ENTRY.size + coded + stored or zlib.crc32(body, zlib.crc32(data[:CHECKED])) != crc:
        raise ValueError("a block is damaged")
    entries = []
    for k in range(documents):
        d, count, flags = ENTRY.unpack_from(body, k * ENTRY.size)
        entries.append((d if flags & HAS_ID else None, count, bool(flags & FIRST), bool(flags & LAST)))
    at = documents * ENTRY.size
    return entries, n, ids_crc, (body[at : at + coded], body[at + coded :])
