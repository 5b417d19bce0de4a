"""Adaptive range coder of id sequences, many blocks side by side.

Inside a block, ids are numbered by first appearance. The last id seen after the same two ids and the last seen after
the same one are the order-2 and order-1 predictions; order 0 is the frequency of the ids so far. Which of the three holds the next
id is itself an adaptive symbol whose odds depend on how often both predictions were right lately and on whether they
agree: that symbol mixes the orders. An id that is new in the block follows in 16 or 32 plain bits.

Every block starts from the same state, so blocks are decoded apart. Arrays run over the blocks; one step codes one id of each.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 2048  # ids of a block; at most 4,096
LANES = 4096  # blocks coded side by side
REFRESH = 16, 256  # least and most ids between two updates of the order-0 table, else a third of the ids so far
_CONTEXTS = 32  # confidence 0-3 of order 2, of order 1, and whether they agree
_WEIGHT_BITS = 3
_WEIGHT = 1 << _WEIGHT_BITS  # of an id that occurred, against a number to come
_LEAST = 64  # least chance of a symbol, of 32768
_HASH = BLOCK
_NONE = 0xFFFC  # no guess yet: a number that no id has
_U = np.uint64
_S15, _S16, _S32, _LOW16, _TOP = _U(15), _U(16), _U(32), _U(0xFFFF), _U(1 << 32)
# A context's symbol bounds are four 16-bit numbers in one 64-bit word: 0 and the three inner ones. The four symbols start evenly;
# _TARGET has the bounds towards which they move after each symbol.
_EVEN = np.array([0, 8192, 16384, 24576], "<u2").view("<u8")
_TARGET = np.array([[0, *(32768 - (4 - j) * _LEAST if j > k else j * _LEAST for j in (1, 2, 3))] for k in range(4)], "<u2").view("<u8").ravel()
_SYMBOL = np.array([2, 1, 0, 0, 3, 3, 3, 3])  # by: order 1 is right, 2 x order 2 is right, 4 x the id is new


class _Coder:
    """State shared by both directions: the model, and the range of every block."""

    def __init__(self, lanes: int, block: int):
        self.range = np.full(lanes, 2**64 - 1, _U)
        lane = np.arange(lanes)
        self.lane, self.lane4, self.lane32, self.lane_counts = lane, lane * 4, lane * _CONTEXTS, lane * (block + 1)
        self.at_first, self.at_second = lane * (block + 1), lanes * (block + 1) + lane * _HASH
        self.guess = np.full(lanes * (block + 1 + _HASH), _NONE, np.uint16)  # of order 1, then of order 2: number << 2 | confidence
        self.bounds = np.repeat(_EVEN, lanes * _CONTEXTS)
        self.edges = np.zeros(4 * lanes + 4, np.uint16)  # of this step's contexts; every fourth one is 0
        self.counts = np.zeros((lanes, block + 1), np.uint16)  # times _WEIGHT
        self.flat_counts = self.counts.ravel()
        self.seen = np.zeros(lanes, np.uint16)
        self.p1, self.p2 = np.full(lanes, block, np.int64), np.zeros(lanes, np.int64)
        self.block, self.due, self.counted = block, 0, 0
        self.held_slots = np.zeros((lanes, 0), np.uint16)

    def refresh(self, t: int, m: int, numbers: np.ndarray, slots: bool = False) -> None:
        """Order-0 frequencies of the first m blocks after t ids: each id of the block so far has _WEIGHT, each number to come until the
        next call 1. With ``slots`` also the numbers in order, as often as they occurred, and after them those to come."""
        fresh = np.ascontiguousarray(numbers[self.counted: t, :m].T)
        np.add.at(self.flat_counts, (fresh + self.lane_counts[:m, None]).ravel(), np.uint16(_WEIGHT))
        ahead = min(max(t // 3, REFRESH[0]), REFRESH[1], self.block - t)
        self.due, self.row, self.past, self.total = t + ahead, t + ahead, t * _WEIGHT, _U(t * _WEIGHT + ahead)
        self.width = int(self.seen[:m].max()) + ahead + 1
        table = np.zeros((m, self.width), np.uint16)
        np.cumsum(np.maximum(self.counts[:m, : self.width - 1], 1), axis=1, dtype=np.uint16, out=table[:, 1:])
        self.table = table.ravel()
        if slots:
            held = np.empty((m, t + ahead), np.uint16)
            held[:, : self.counted] = self.held_slots[:m, : self.counted]
            held[:, self.counted: t] = fresh
            held[:, :t].sort(axis=1)
            np.add(self.seen[:m, None], np.arange(ahead, dtype=np.uint16), out=held[:, t:])
            self.held_slots, self.slots = held, held.ravel()
        self.counted = t

    def predict(self, m: int) -> None:
        p1 = self.p1[:m]
        self.at = at = np.empty((2, m), np.int64)
        np.add(self.at_first[:m], p1, out=at[0])
        second = p1 * 40503
        second += self.p2[:m]
        second >>= 2
        second &= _HASH - 1
        np.add(self.at_second[:m], second, out=at[1])
        self.held = held = self.guess.take(at)
        self.sure = sure = held & 3
        self.number = number = held >> 2
        context = sure[1] << 2
        context |= sure[0]
        context <<= 1
        context |= number[0] == number[1]
        self.context = self.lane32[:m] + context
        self.bound = self.bounds.take(self.context, out=self.edges[: 4 * m].view("<u8"), mode="clip")

    def learn(self, m: int, number: np.ndarray, symbol: np.ndarray, hits: np.ndarray, new: np.ndarray) -> None:
        """Both predictions, the symbol's odds and the counts after an id."""
        bound = self.bound.view(np.int16)
        move = _TARGET.take(symbol).view(np.int16)
        move -= bound
        move >>= 5
        move += bound
        self.bounds[self.context] = move.view("<u8")
        held, sure = self.held, self.sure
        missed = np.where(sure > 1, held - 1, number << 2 | 1)
        held += sure < 3
        self.guess[self.at] = np.where(hits, held, missed)
        np.multiply(self.p1[:m], 2531, out=self.p2[:m])
        self.p1[:m] = number
        self.seen[new] += np.uint16(1)

    def narrow(self, m: int, symbol: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Takes a symbol's interval in each of the first m blocks; the distance by which low grows."""
        at = self.lane4[:m] + symbol
        start = self.edges.take(at)
        at += 1
        size = self.edges.take(at)
        size -= start
        size &= 0x7FFF
        np.multiply(step, size, out=self.range[:m])
        return step * start


def _numbers(ids: np.ndarray, block: int) -> np.ndarray:
    """Number of each id by first appearance in its block; a column per block, the last one's end unset."""
    if int(ids.max()) >= 1 << 20:
        ids = np.unique(ids, return_inverse=True)[1].ravel()
    first, place = np.empty(int(ids.max()) + 1, np.int64), np.arange(block)
    out = np.zeros((-(-len(ids) // block), block), np.uint16)
    for k, row in enumerate(out):
        own = ids[k * block: (k + 1) * block].astype(np.int64)
        at = place[: len(own)]
        first[own[::-1]] = at[::-1]  # of a repeated id, the assignment made last stays
        begin = first[own]
        rank = np.cumsum(begin == at, dtype=np.uint16)
        rank -= 1
        row[: len(own)] = rank.take(begin)
    return np.ascontiguousarray(out.T)


def _encode(ids: np.ndarray, block: int, wide: bool) -> tuple[list[bytes], list[int]]:
    lanes = -(-len(ids) // block)
    numbers = _numbers(ids, block)
    coder = _Coder(lanes, block)
    low, range_ = np.zeros(lanes, _U), coder.range
    room = (1 + wide) * block + 4
    out = np.zeros((lanes, room), np.uint32)
    flat, base = out.ravel(), np.arange(lanes) * room
    pos = base.copy()
    last = len(ids) - (lanes - 1) * block

    def settle(on: np.ndarray) -> None:
        """Moves out the leading 32 bits of some blocks whose range is below that."""
        at = pos[on]
        held = low[on]
        flat[at] = held >> _S32
        pos[on] = at + 1
        low[on] = held << _S32
        range_[on] <<= _S32

    def carry(on: np.ndarray) -> None:
        """Adds one to what some blocks have moved out."""
        at = pos[on] - 1
        while len(at):
            flat[at] += np.uint32(1)
            at = at[flat[at] == 0] - 1

    for t in range(block if lanes > 1 else last):
        m = lanes if t < last else lanes - 1
        if t == coder.due:
            coder.refresh(t, m, numbers)
        coder.predict(m)
        number = numbers[t, :m]
        hits = coder.number == number
        kind = hits[1].view(np.uint8) << 1
        kind |= hits[0].view(np.uint8)
        kind |= (number >= coder.seen[:m]).view(np.uint8) << 2
        symbol = _SYMBOL.take(kind)
        by = coder.narrow(m, symbol, range_[:m] >> _S15)
        old, new = (symbol == 2).nonzero()[0], (symbol == 3).nonzero()[0]
        if len(old):
            step = range_.take(old) // coder.total
            at = old * coder.width + number.take(old)
            start = coder.table.take(at)
            at += 1
            range_[old] = step * (coder.table.take(at) - start)
            by[old] += step * start
        if len(new):
            step = range_.take(new) >> _S16
            raw = ids.take(new * block + t)
            by[new] += step * (raw & 0xFFFF)
            range_[new] = step
        own = low[:m]
        own += by
        over = (own < by).nonzero()[0]
        if len(over):
            carry(over)
        on = (range_[:m] < _TOP).nonzero()[0]
        if len(on):
            settle(on)
        if wide and len(new):
            step = range_.take(new) >> _S16
            by = step * (raw >> 16)
            low[new] += by
            carry(new[low[new] < by])
            range_[new] = step
            settle(new[step < _TOP])
        coder.learn(m, number, symbol, hits, new)
    every = coder.lane
    settle(every)
    settle(every)
    return [row[:n].astype("<u4").tobytes() for row, n in zip(out, pos - base)], (pos - base).tolist()


def encode(ids: np.ndarray, block: int = BLOCK, wide: bool = False) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Payload, end of every block in it, and the crc32 of every block's ids as little-endian 32-bit integers."""
    payload, words = [], []
    for a in range(0, len(ids), LANES * block):
        got, n = _encode(ids[a: a + LANES * block], block, wide)
        payload += got
        words += n
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    sums = np.array([zlib.crc32(raw[4 * a: 4 * (a + block)]) for a in range(0, len(ids), block)], np.int64)
    return b"".join(payload), np.cumsum(np.array(words, np.int64)) * 4, sums


def _decode(words: np.ndarray, pos: np.ndarray, n: int, block: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ids, and which blocks don't end at the low that was moved out last."""
    lanes = len(pos)
    stop = len(words) - 1
    pos = pos.copy()
    coder = _Coder(lanes, block)
    range_ = coder.range
    code = words[np.minimum(pos, stop)] << _S32 | words[np.minimum(pos + 1, stop)]  # relative to low
    pos += 2
    known = np.zeros((lanes, block + 1), np.uint32)
    flat_known, lane_known = known.ravel(), coder.lane * (block + 1)
    out = np.zeros((block, lanes), np.uint16)
    last = n - (lanes - 1) * block

    def settle(on: np.ndarray) -> None:
        at = pos[on]
        code[on] = code[on] << _S32 | words.take(at, mode="clip")
        pos[on] = at + 1
        range_[on] <<= _S32

    for t in range(block if lanes > 1 else last):
        m = lanes if t < last else lanes - 1
        if t == coder.due:
            coder.refresh(t, m, out, slots=True)
        coder.predict(m)
        step = range_[:m] >> _S15
        value = (code[:m] // step).astype(np.uint16)
        reached = (value[:, None] >= coder.edges[: 4 * m].reshape(m, 4)).view("<u4").ravel()
        symbol = ((reached * np.uint32(0x01010101)) >> np.uint32(24)).astype(np.int64)
        symbol -= 1
        code[:m] -= coder.narrow(m, symbol, step)
        number = np.concatenate((coder.number[1], coder.number[0], coder.seen[:m], coder.seen[:m])).take(symbol * m + coder.lane[:m])
        old, new = (symbol == 2).nonzero()[0], (symbol == 3).nonzero()[0]
        if len(old):
            step = range_.take(old) // coder.total
            own = code.take(old)
            at = np.minimum(own // step, coder.total - _U(1)).astype(np.int64)
            at = np.where(at < coder.past, at >> _WEIGHT_BITS, at - (coder.past - coder.counted))
            at += old * coder.row
            number[old] = got = coder.slots.take(at)
            at = old * coder.width + got
            start = coder.table.take(at)
            at += 1
            code[old] = own - step * start
            range_[old] = step * (coder.table.take(at) - start)
        if len(new):
            step = range_.take(new) >> _S16
            own = code.take(new)
            raw = np.minimum(own // step, _LOW16)
            code[new] = own - step * raw
            range_[new] = step
        on = (range_[:m] < _TOP).nonzero()[0]
        if len(on):
            settle(on)
        if len(new):
            if wide:
                step = range_.take(new) >> _S16
                high = np.minimum(code.take(new) // step, _LOW16)
                code[new] -= step * high
                range_[new] = step
                raw |= high << _S16
                settle(new[step < _TOP])
            flat_known[lane_known.take(new) + coder.seen.take(new)] = raw
        np.minimum(number, coder.seen[:m], out=number)  # beyond only in broken input
        out[t, :m] = number
        coder.learn(m, number, symbol, coder.number == number, new)
    ids = np.empty((lanes, block), np.uint32)
    for own, row, number in zip(ids, known, out.T):
        row.take(number, out=own, mode="clip")
    return ids.ravel()[:n], code != 0


def decode(payload: bytes, ends: np.ndarray, sums: np.ndarray, n: int, block: int = BLOCK, wide: bool = False) -> np.ndarray:
    """The ids again; raises ValueError when a block's checksum does not match."""
    if not n:
        return np.zeros(0, np.uint32)
    words = np.concatenate((np.frombuffer(payload, "<u4"), np.zeros(2, np.uint32))).astype(_U)
    pos = np.concatenate(([0], np.asarray(ends[:-1], np.int64) // 4))
    with np.errstate(all="ignore"):  # broken input may lead to an empty range
        parts = [_decode(words, pos[k: k + LANES], min(n - k * block, LANES * block), block, wide) for k in range(0, len(pos), LANES)]
    ids, off = (np.concatenate(p) for p in zip(*parts))
    raw = memoryview(ids.astype("<u4")).cast("B")
    for k, a in enumerate(range(0, n, block)):
        if off[k] or zlib.crc32(raw[4 * a: 4 * (a + block)]) != int(sums[k]):
            raise ValueError(f"block {k}: checksum or end does not match")
    return ids
