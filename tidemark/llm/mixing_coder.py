"""An adaptive context-mixing range coder for token ids.

Each id is predicted twice: by what followed the last two ids before, and by
what followed the last one.  The coder first codes which prediction holds, if
any, with counts mixed from the confidence of both orders, and otherwise the id
itself by adaptive order-0 counts of its two bytes.  Blocks start afresh, carry
a checksum and are coded side by side, one lane of the arrays for each.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block; ids must be below 2**16.
BLOCK = 4096
MAGIC = b"TMX1"
_HEADER = struct.Struct("<4sIIII")
_BITS, _TOTAL = 15, 1 << 15
_SLOTS = 1 << 11
#: Entries that a lane has in a table of byte frequencies: 257 and padding to a multiple of 16.
_ROW = 272
_LOW_BITS, _WORD = 48, 16
_LEAST_RANGE = np.uint64(1 << 32)
_U = np.uint64


class _Models:
    """The adaptive state of ``n`` lanes; the coder and the decoder feed it the same ids."""

    def __init__(self, n: int):
        self.base = np.arange(n, dtype=np.int64) * _SLOTS
        self.tables = [np.zeros(n * _SLOTS, np.int32) for _ in range(2)]  # id << 2 | confidence, for orders 1 and 2
        self.one, self.two = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.outcomes = np.ones((n, 16, 3), np.int32)
        self.outcomes[:, :, 2] = 2
        self.bytes = [np.ones((n, 256), np.int32) for _ in range(2)]
        self.lane = np.arange(n, dtype=np.int64)
        self.refresh(n, True, True)

    def refresh(self, m: int, outcomes: bool, literals: bool) -> None:
        """Turn the counts of the first ``m`` lanes into frequencies that sum to ``_TOTAL``."""
        if outcomes:
            joint = self.outcomes[:m].reshape(m, 4, 4, 3)
            mixed = 4 * joint + joint.sum(1, keepdims=True) + joint.sum(2, keepdims=True)
            share = 1 + mixed * (_TOTAL - 3) // mixed.sum(3, keepdims=True)
            edges = np.zeros((m, 16, 4), np.uint64)
            np.cumsum(share.reshape(m, 16, 3)[:, :, :2], axis=2, out=edges[:, :, 1:3])
            edges[:, :, 3] = _TOTAL
            self.edges = edges.reshape(-1)
        if literals:
            self.steps, self.coarse = [], []
            for counts in self.bytes:
                c = counts[:m].astype(np.int64)
                share = 1 + c * (_TOTAL - 256) // c.sum(1, keepdims=True)
                step = np.zeros((m, _ROW), np.uint16)
                np.cumsum(share, axis=1, out=step[:, 1:257], dtype=np.uint16)
                step[:, 256] = _TOTAL
                self.steps.append(step.reshape(-1))
                self.coarse.append(np.ascontiguousarray(step[:, :256:16]))

    def predict(self, m: int) -> None:
        self.at1 = self.base[:m] + (((self.one[:m] * 40503) >> 4) & (_SLOTS - 1))
        self.at2 = self.base[:m] + (((self.one[:m] * 40503 + self.two[:m] * 30011) >> 3) & (_SLOTS - 1))
        self.e1, self.e2 = self.tables[0].take(self.at1), self.tables[1].take(self.at2)
        self.p1, self.p2 = self.e1 >> 2, self.e2 >> 2
        self.context = self.lane[:m] * 16 + ((self.e2 & 3) << 2) + (self.e1 & 3)

    def learn(self, m: int, ids: np.ndarray, outcome: np.ndarray, missed: np.ndarray) -> None:
        x = ids.astype(np.int32)
        for table, at, e, p in ((self.tables[0], self.at1, self.e1, self.p1), (self.tables[1], self.at2, self.e2, self.p2)):
            sure = e & 3
            table[at] = np.where(p == x, e + (sure < 3), np.where(sure > 0, e - 1, x << 2))
        self.outcomes.reshape(-1)[self.context * 3 + outcome] += 1
        if len(missed):
            lost = ids[missed]
            self.bytes[0][missed, lost >> 8] += 24
            self.bytes[1][missed, lost & 255] += 24
        self.two[:m] = self.one[:m]
        self.one[:m] = ids

    @staticmethod
    def due(t: int) -> tuple[bool, bool]:
        """Whether outcomes and literals are refreshed before step ``t``."""
        power = t & (t - 1) == 0
        return t >= 8 and (power or t % 64 == 0), t >= 8 and (power or t % 256 == 0)


def _lanes(blocks: list) -> tuple[np.ndarray, np.ndarray]:
    """Longest blocks first, so that the lanes in use are always the first ones."""
    sizes = np.array([len(b) for b in blocks], np.int64)
    order = np.argsort(-sizes, kind="stable")
    return order, sizes[order]


class _Encoder:
    def __init__(self, n: int, longest: int):
        self.low, self.range = np.zeros(n, _U), np.full(n, (1 << _LOW_BITS) - 1, _U)
        self.out, self.at = np.zeros((n, 3 * longest + 4), np.uint16), np.zeros(n, np.int64)

    def code(self, k: np.ndarray | slice, cum: np.ndarray, freq: np.ndarray) -> None:
        """Code an interval of ``_TOTAL`` in each of the lanes ``k``, which are some or the first ones."""
        share = self.range[k] >> _U(_BITS)
        low, width = self.low[k] + cum * share, freq * share
        over = np.flatnonzero(low >> _U(_LOW_BITS))
        if len(over):
            low[over] &= _U((1 << _LOW_BITS) - 1)
            lanes = over if isinstance(k, slice) else k[over]
            place = self.at[lanes] - 1
            while len(lanes):  # the carry runs through words of ones
                self.out[lanes, place] += np.uint16(1)
                more = self.out[lanes, place] == 0
                lanes, place = lanes[more], place[more] - 1
        small = np.flatnonzero(width < _LEAST_RANGE)
        if len(small):
            lanes = small if isinstance(k, slice) else k[small]
            self.out[lanes, self.at[lanes]] = (low[small] >> _U(_LOW_BITS - _WORD)).astype(np.uint16)
            self.at[lanes] += 1
            low[small] = (low[small] << _U(_WORD)) & _U((1 << _LOW_BITS) - 1)
            width[small] <<= _U(_WORD)
        self.low[k], self.range[k] = low, width

    def finish(self) -> list[bytes]:
        words = np.stack([(self.low >> _U(s)).astype(np.uint16) for s in (32, 16, 0)], 1)
        return [np.concatenate((self.out[i, : self.at[i]], words[i])).astype("<u2").tobytes() for i in range(len(self.at))]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded form of each block of ids: a header (magic, ids, words, checksum of the ids, checksum of the words) and 16-bit words."""
    if not blocks:
        return []
    order, sizes = _lanes(blocks)
    n, longest = len(blocks), int(sizes[0])
    ids = np.zeros((longest, n), np.int64)
    for lane, b in enumerate(order):
        ids[: sizes[lane], lane] = blocks[b]
    if longest and ids.max() >> 16:
        raise ValueError("ids must be below 65536")
    models, coder = _Models(n), _Encoder(n, longest)
    m = n
    for t in range(longest):
        while sizes[m - 1] <= t:
            m -= 1
        models_due = models.due(t)
        if any(models_due):
            models.refresh(m, *models_due)
        x = ids[t, :m]
        models.predict(m)
        outcome = np.where(x == models.p2, 0, np.where(x == models.p1, 1, 2))
        at = models.context * 4 + outcome
        cum = models.edges.take(at)
        coder.code(slice(0, m), cum, models.edges.take(at + 1) - cum)
        missed = np.flatnonzero(outcome == 2)
        if len(missed):
            lost = x[missed]
            for steps, value in zip(models.steps, (lost >> 8, lost & 255), strict=True):
                at = missed * _ROW + value
                cum = steps.take(at).astype(_U)
                coder.code(missed, cum, steps.take(at + 1).astype(_U) - cum)
        models.learn(m, x, outcome, missed)
    out: list[bytes] = [b""] * n
    for lane, words in enumerate(coder.finish()):
        block = blocks[order[lane]]
        out[order[lane]] = _HEADER.pack(MAGIC, len(block), len(words) // 2, zlib.crc32(np.asarray(block, "<u4").tobytes()), zlib.crc32(words)) + words
    return out


class _Decoder:
    def __init__(self, words: list[np.ndarray]):
        n = len(words)
        self.words, self.at = np.zeros((n, max(map(len, words)) + 1), np.uint16), np.full(n, 3, np.int64)
        for i, w in enumerate(words):
            self.words[i, : len(w)] = w
        first = self.words[:, :3].astype(_U)
        self.code_, self.range = (first[:, 0] << _U(32)) | (first[:, 1] << _U(16)) | first[:, 2], np.full(n, (1 << _LOW_BITS) - 1, _U)

    def target(self, k: np.ndarray | slice) -> np.ndarray:
        self.share = self.range[k] >> _U(_BITS)
        return np.minimum(self.code_[k] // self.share, _U(_TOTAL - 1))

    def take(self, k: np.ndarray | slice, cum: np.ndarray, freq: np.ndarray) -> None:
        code, width = self.code_[k] - cum * self.share, freq * self.share
        small = np.flatnonzero(width < _LEAST_RANGE)
        if len(small):
            lanes = small if isinstance(k, slice) else k[small]
            code[small] = (code[small] << _U(_WORD)) | self.words[lanes, self.at[lanes]]
            self.at[lanes] += 1
            width[small] <<= _U(_WORD)
        self.code_[k], self.range[k] = code, width


def decode_blocks(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each block, as uint32; a damaged block raises ``ValueError``."""
    if not coded:
        return []
    words, counts, sums = [], [], []
    for raw in coded:
        if len(raw) < _HEADER.size:
            raise ValueError("a block is cut short")
        magic, n_ids, n_words, ids_crc, words_crc = _HEADER.unpack_from(raw)
        body = raw[_HEADER.size :]
        if magic != MAGIC or len(body) != 2 * n_words or zlib.crc32(body) != words_crc:
            raise ValueError("a block is damaged")
        words.append(np.frombuffer(body, "<u2"))
        counts.append(np.broadcast_to(np.uint8(0), n_ids))
        sums.append(ids_crc)
    order, sizes = _lanes(counts)
    n, longest = len(coded), int(sizes[0])
    ids = np.zeros((longest, n), np.uint32)
    models, coder = _Models(n), _Decoder([words[i] for i in order])
    m = n
    for t in range(longest):
        while sizes[m - 1] <= t:
            m -= 1
        models_due = models.due(t)
        if any(models_due):
            models.refresh(m, *models_due)
        models.predict(m)
        lanes = slice(0, m)
        target, at = coder.target(lanes), models.context * 4
        outcome = (target >= models.edges.take(at + 1)).astype(np.int64) + (target >= models.edges.take(at + 2))
        at += outcome
        cum = models.edges.take(at)
        coder.take(lanes, cum, models.edges.take(at + 1) - cum)
        x = np.where(outcome == 0, models.p2, models.p1).astype(np.int64)
        missed = np.flatnonzero(outcome == 2)
        if len(missed):
            value = np.zeros(len(missed), np.int64)
            for steps, coarse in zip(models.steps, models.coarse, strict=True):
                target = coder.target(missed).astype(np.uint16)[:, None]
                part = np.count_nonzero(coarse.take(missed, 0) <= target, 1) - 1
                fine = np.count_nonzero(steps.reshape(-1, 16).take(missed * (_ROW // 16) + part, 0) <= target, 1) - 1
                byte = part * 16 + fine
                at = missed * _ROW + byte
                cum = steps.take(at).astype(_U)
                coder.take(missed, cum, steps.take(at + 1).astype(_U) - cum)
                value = (value << 8) | byte
            x[missed] = value
        models.learn(m, x, outcome, missed)
        ids[t, :m] = x
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
    for lane, b in enumerate(order):
        out[b] = np.ascontiguousarray(ids[: sizes[lane], lane])
        if zlib.crc32(out[b].astype("<u4").tobytes()) != sums[b]:
            raise ValueError("a block doesn't decode to its checksum")
    return out
